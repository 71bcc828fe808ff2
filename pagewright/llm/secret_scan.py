"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans to theirs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, rows_of, text_of

#: Kinds in the order that breaks ties of starts.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Tokens, which marks of keys may join, and what is between them.
PIECE = re.compile(r"\w++(?:[+/.-]++\w++)*+(?:={1,2}(?![\w=]))?|\W++")
STATES = "BIO"
#: Rows that fitting looks at, at most (those with the smallest hashes of their ids), and their windows that it collects.
MOST_FIT, MOST_WINDOWS = 3000, 2500
#: Tokens of such a window, and characters of a token that its features look at.
WINDOW, LONGEST = 24, 128
STEPS, RIDGE = 80, 0.001
#: Strings whose weights a worker remembers, and tokens that are tagged together.
MOST_STRINGS, GROUP = 500_000, 1 << 18

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each fixed kind; of assignments the value, 8 characters or more."""
    raw, out = text.encode("utf-8", "surrogatepass").lower(), []
    if any(word in raw for word in KEYWORDS):
        out += [("assign", *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def pieces_of(text: str) -> list[str]:
    """Gap, token, gap, ..., gap: all of a text."""
    pieces = PIECE.findall(text)
    if not pieces or pieces[0][0].isalnum() or pieces[0][0] == "_":
        pieces.insert(0, "")
    if len(pieces) % 2 == 0:
        pieces.append("")
    return pieces


def shape(token: str) -> str:
    """Classes of characters with repeats left out."""
    return re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", token))))


_hint = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential|phrase|login")


def file_feature(text: str) -> str:
    """What the whole text looks like: its length and how much of it is code."""
    code = sum(map(text.count, "={};")) * 200 // (len(text) + 200)
    return f"length {len(text).bit_length() // 3} code {min(code, 4)}"


def own_features(token: str) -> list[str]:
    """What a token itself looks like."""
    token = token[:LONGEST]
    if token.isalpha() and (token.islower() or token[1:].islower()) and len(token) < 20:
        return ["any", "plain word", f"plain length {len(token) // 4}", "is " + token.lower()]
    counts = Counter(token)
    entropy = -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values()) if token else 0.0
    digits = sum(map(str.isdigit, token))
    kinds = ("lower " * bool(re.search("[a-z]", token))) + ("upper " * bool(re.search("[A-Z]", token))) + ("mark " * bool(re.search(r"[+/_.=-]", token)))
    turns = len(re.findall("[a-z][A-Z]", token))
    return [
        "any",
        "shape " + shape(token)[:12],
        f"length {min(len(token), 64) // 4}",
        f"entropy {min(round(2 * entropy), 10)} kinds {kinds}",
        f"digits {round(6 * digits / max(1, len(token)))} kinds {kinds}",
        f"turns {min(turns, 4)} long {min(len(token) // 8, 4)}",
        "begins " + re.sub("[0-9]", "9", token[:4]),
        f"dots {min(token.count('.'), 3)} slashes {min(token.count('/'), 3)} dashes {min(token.count('-'), 3)}",
        "hex" if re.fullmatch(r"[0-9a-f]+", token) else "not hex",
    ]


def beside_features(token: str) -> list[str]:
    """What a token tells of its neighbours; the empty one is the end of a line."""
    token = token[:LONGEST]
    low = token.lower()
    kind = "end" if not token else "plain" if token.isalpha() and not token[1:].isupper() else shape(token)[:6]
    return [f"kind {kind}", f"hint {bool(_hint.search(low))}", "is " + low if len(low) < 20 else "long"]


def gap_features(gap: str) -> list[str]:
    marks = "".join(gap.split())
    return [f"marks {marks[-3:]}", f"blank {gap != marks}", f"assigned {bool(re.search('[=:]', marks))}"]


def joint_feature(before: int, assigned: int, own: int) -> str:
    return f"hint before {before} assigned {assigned} own {own}"


def is_hint(token: str) -> int:
    return int(bool(_hint.search(token[:LONGEST].lower())))


def is_assigned(gap: str) -> int:
    return int("=" in gap or ":" in gap)


def size_class(token: str) -> int:
    """Short, long, or long and mixed: 0 to 3 by length, 4 more where it isn't a plain word."""
    return min(len(token) // 6, 3) + 4 * (not (token.isalpha() and (token.islower() or token[1:].islower())))


#: Places whose features a token has, besides joint and file features: itself, its neighbours, and the gaps around it.
PLACES = {"own": own_features, "before": beside_features, "before that": beside_features, "after": beside_features, "gap before": gap_features, "gap after": gap_features}


def line_features(tokens: list[str], gaps: list[str], file: str) -> list[list[str]]:
    """Names of all features of each token of a line; ``gaps`` has one more."""
    out = []
    for i, token in enumerate(tokens):
        at = {
            "own": token, "before": tokens[i - 1] if i else "", "before that": tokens[i - 2] if i > 1 else "",
            "after": tokens[i + 1] if i + 1 < len(tokens) else "", "gap before": gaps[i], "gap after": gaps[i + 1],
        }
        names = [f"{place}: {name}" for place, of in PLACES.items() for name in of(at[place])]
        out.append([*names, joint_feature(is_hint(at["before"]), is_assigned(gaps[i]), size_class(token)), "file: " + file])
    return out


@dataclass
class Model:
    """Weights of features for B, I and O, of steps between them, and of first states."""

    names: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((1, 3)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def weight(self, names: Iterable[str]) -> np.ndarray:
        return self.emit[[self.names[x] for x in names if x in self.names]].sum(0)


def viterbi(emit: np.ndarray, step: np.ndarray, first: np.ndarray) -> list[int]:
    """The best states; inside never comes first or after outside."""
    score, back = emit[0] + first, []
    for row in emit[1:]:
        all_ = score[:, None] + step + row
        back.append(all_.argmax(0))
        score = all_.max(0)
    path = [int(score.argmax())]
    for places in reversed(back):
        path.append(int(places[path[-1]]))
    return path[::-1]


def best_paths(emits: list[np.ndarray], step: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """``viterbi`` of many sequences at once, place by place over those that are as long."""
    sizes = np.array([len(x) for x in emits], np.int64)
    order = np.argsort(-sizes, kind="stable")
    out = [np.zeros(0, np.int8)] * len(emits)
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        long = sizes[part]
        flat, starts = np.concatenate([emits[i] for i in part]), np.cumsum(long) - long
        score = flat[starts] + first
        back = [np.zeros((len(part), 3), np.int8)]
        for t in range(1, int(long[0])):
            n = int(np.searchsorted(-long, -t, "left"))  # sequences of more than t tokens
            all_ = score[:n, :, None] + step
            back.append(all_.argmax(1).astype(np.int8))
            score[:n] = all_.max(1) + flat[starts[:n] + t]
        for i, k in enumerate(part.tolist()):
            path = np.zeros(long[i], np.int8)
            path[-1] = score[i].argmax()
            for t in range(int(long[i]) - 1, 0, -1):
                path[t - 1] = back[t][i, path[t]]
            out[k] = path
    return out


#: Steps that can't be: to inside from outside, and to inside at first.
_BAN = np.zeros((3, 3))
_BAN[2, 1] = -1e4
_FIRST_BAN = np.array([0, -1e4, 0.0])


def fit_crf(sequences: list[tuple[list[list[str]], list[int]]]) -> Model:
    """Maximum likelihood with a ridge, by Adam on forward-backward expectations over all sequences at once."""
    counts = Counter(name for rows, _ in sequences for row in rows for name in row)
    names = {name: i for i, name in enumerate(sorted(name for name, n in counts.items() if n >= 2))}
    if not sequences or not names:
        return Model(first=np.array([-1e4, -1e4, 0.0]))
    deep = max(len(s) for _, s in sequences)
    tokens = [(i, t, [names[x] for x in row if x in names]) for i, (rows, _) in enumerate(sequences) for t, row in enumerate(rows)]
    at = np.array([(i, t) for i, t, _ in tokens])
    flat = np.concatenate([np.array(row, int) for _, _, row in tokens])
    owner = np.repeat(np.arange(len(tokens)), [len(row) for _, _, row in tokens])
    heads = np.cumsum([0, *(len(row) for _, _, row in tokens[:-1])])
    gold = np.zeros((len(sequences), deep), int)
    mask = np.zeros((len(sequences), deep), bool)
    for i, (_, states) in enumerate(sequences):
        gold[i, : len(states)], mask[i, : len(states)] = states, True
    seen = np.eye(3)[gold] * mask[..., None]
    seen_step = sum((seen[:, t, :, None] * seen[:, t + 1, None, :]).sum(0) for t in range(deep - 1)) if deep > 1 else np.zeros((3, 3))
    params = [np.zeros((len(names), 3)), np.zeros((3, 3)), np.zeros(3)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    n = len(sequences)

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for k in range(1, STEPS + 1):
        per_token = np.add.reduceat(params[0][flat], heads, axis=0)
        emit = np.zeros((n, deep, 3))
        emit[at[:, 0], at[:, 1]] = per_token
        step, first = params[1] + _BAN, params[2] + _FIRST_BAN
        forward, backward = np.zeros((n, deep, 3)), np.zeros((n, deep, 3))
        forward[:, 0] = emit[:, 0] + first
        for t in range(1, deep):
            new = log_sum(forward[:, t - 1, :, None] + step, 1) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(deep - 2, -1, -1):
            new = log_sum(step + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = log_sum(forward[:, -1], 1)
        node = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        pair = np.zeros((3, 3))
        for t in range(deep - 1):
            both = forward[:, t, :, None] + step + (emit[:, t + 1] + backward[:, t + 1])[:, None, :] - total[:, None, None]
            pair += (np.exp(both) * mask[:, t + 1, None, None]).sum(0)
        off = (node - seen)[at[:, 0], at[:, 1]]
        slopes = [
            np.stack([np.bincount(flat, off[owner, s], len(names)) for s in range(3)], 1) / n + RIDGE * params[0],
            (pair - seen_step) / n + RIDGE * params[1],
            (node[:, 0] - seen[:, 0]).sum(0) / n + RIDGE * params[2],
        ]
        for p, (m, v), slope in zip(params, moments, slopes, strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            p -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(names, params[0], params[1] + _BAN, params[2] + _FIRST_BAN)


def windows(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[list[str], list[str], list[int], str]]:
    """``tokens, gaps, states, file`` of the lines of a text, in parts of WINDOW tokens; a token in a span begins it or goes on with it."""
    pieces, file = pieces_of(text), file_feature(text)
    spans, at, last = sorted(spans), 0, None
    tokens, gaps, states = [], [pieces[0]], []
    for token, gap in zip(pieces[1::2], pieces[2::2], strict=True):
        begin = at + len(gaps[-1])
        at = begin + len(token)
        while spans and spans[0][1] <= begin:
            spans.pop(0)
        span = spans[0] if spans and spans[0][0] < at else None
        states.append(2 if span is None else 1 if span == last else 0)
        last = span
        tokens.append(token[:LONGEST])
        gaps.append(gap)
        if "\n" in gap or len(tokens) == WINDOW:
            yield tokens, gaps, [0 if k == 0 and x == 1 else x for k, x in enumerate(states)], file
            tokens, gaps, states = [], [gap], []
    if tokens:
        yield tokens, gaps, [0 if k == 0 and x == 1 else x for k, x in enumerate(states)], file


def labelled(text: str, spans: list[tuple[int, int]]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and states of the windows of a text."""
    return [(line_features(tokens, gaps, file), states) for tokens, gaps, states, file in windows(text, spans)]


def examples(count: int = 1200, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Made-up texts with one item each, so that every kind is learned whatever the corpus holds."""
    rng = random.Random(seed)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda n, a=alphabet: "".join(rng.choices(a, k=n - 1)) + rng.choice("0123456789")
    word = lambda: "".join(rng.choices("aeinorstlhd", k=rng.randint(2, 9)))
    secrets = (
        lambda: some(rng.randint(16, 44)),
        lambda: some(20) + "/" + some(8) + "+" + some(10),
        lambda: rng.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk-", "sk_live_", "pk_live_", "AIza", "npm_", "hf_"]) + some(rng.randint(20, 40)),
        lambda: "AKIA" + some(16, alphabet[:26] + alphabet[52:]),
        lambda: "eyJ" + some(30) + "." + some(40) + "." + some(30),
        lambda: some(rng.randint(32, 64), "0123456789abcdef"),
        lambda: "".join(rng.choices(alphabet[:52], k=rng.randint(14, 30))),
        lambda: "-".join(word() + word() for _ in range(rng.randint(3, 5))),
    )
    plain = (
        lambda: f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com",
        lambda: f"https://{word()}{rng.randint(1, 9)}.example.org/{word()}/{rng.randint(1, 99999)}",
        lambda: f"+{rng.randint(1, 99)} {rng.randint(100, 999)}-555-{rng.randint(1000, 9999)}",
        lambda: some(rng.choice([13, 15, 16, 19]), "0123456789"),
        lambda: f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}",
        lambda: f"{word()}-{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: f"192.168.{rng.randint(0, 255)}.{rng.randint(10, 255)}",
        lambda: f"{word()}_{word()}_{rng.randint(1, 999)}",
        lambda: f"{word()}{word()}{rng.randint(1, 999)}",
        lambda: "-".join(some(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)),
        lambda: f"{rng.choice(['GB', 'DE', 'FR', 'ES'])}{some(20, '0123456789')}",
    )
    phrase = lambda: " ".join(word() for _ in range(rng.randint(3, 6)))
    given = ('{} = "', "{}: ", "{}=", "export {}='", "Authorization: Bearer ", "{} is ", '"{}": "', "")
    for i in range(count):
        words = [word() for _ in range(rng.randint(4, 40))]
        before = " ".join(words[: len(words) // 2]) + " "
        if i % 2:
            name = rng.choice(["password", "token", "secret_key", "API_KEY", "auth", "access_key", "client_secret", "pwd"])
            lead, item = rng.choice(given).format(name), rng.choice(secrets)()
            if i % 10 == 1:  # of several tokens, to the closing mark
                lead, item = rng.choice(["passphrase", "pass phrase", "recovery phrase"]) + rng.choice([': "', ' = "', "='"]), phrase()
            spans = [(len(before + lead), len(before + lead + item))]
        else:
            lead, item, spans = rng.choice(["", "", "id: ", "see ", 'name = "']), rng.choice(plain)(), []
        yield before + lead + item + rng.choice(['"', " ", ".", "\n", ";"]) + " " + " ".join(words[len(words) // 2 :]), spans


def train(docs: DataFrame, most: int = MOST_FIT, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on made-up examples and on windows of ``most`` rows at most, labelled by the fixed patterns.

    MOST_WINDOWS windows come to the driver, those with a span first, then those with the smallest hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    keys = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    schema = pa.schema([("tokens", pa.list_(pa.string())), ("gaps", pa.list_(pa.string())), ("states", pa.list_(pa.int32())), ("file", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (text,) in rows_of(batches):
                for tokens, gaps, states, file in windows(text, [(a, b) for _, a, b in base_spans(text)]):
                    yield tokens, [gap[-LONGEST:] for gap in gaps], states, file

        return batches_of(found(), schema, weigh=lambda row: 64 * len(row[0]))

    cut = rows.join(F.broadcast(keys), "id").select("text").mapInArrow(run, "tokens array<string>, gaps array<string>, states array<int>, file string")
    sample = cut.distinct().orderBy(F.array_min("states") == 2, F.xxhash64("tokens", "gaps"), "tokens", "gaps", "states", "file").limit(MOST_WINDOWS)
    sequences = [s for text, spans in examples() for s in labelled(text, spans)]
    sequences += [(line_features(r.tokens, r.gaps, r.file), r.states) for r in sample.collect()]
    return fit_crf(sequences)


class Tagger:
    """Tags all tokens of many texts at once: tokens with the same known features share a row of weights, rows are added up by place."""

    SIDES = ("own", "before", "before that", "after")

    def __init__(self, model: Model):
        self.model = model
        self.names = {place: {name.removeprefix(place + ": "): i for name, i in model.names.items() if name.startswith(place + ": ")} for place in PLACES}
        #: Words that are features themselves; all other plain words of a length have one row.
        self.vocabulary = {name[3:] for place in self.SIDES for name in self.names[place] if name.startswith("is ")}
        self.joint = np.array([[[model.weight([joint_feature(a, b, c)]) for c in range(8)] for b in range(2)] for a in range(2)])
        self.files: dict[str, np.ndarray] = {}
        self.gaps: dict[str, int] = {}
        #: Of a gap: weights before and after, whether it assigns, whether it ends a line.
        self.gap_rows: list[tuple] = []
        self.tokens: dict[str, int] = {}
        self.rows: dict[tuple, int] = {}
        #: Of a token: weights by place, whether it hints at a secret, its size class.
        self.token_rows: list[tuple] = []
        step, first = model.step, model.first
        #: What a span can gain by its steps against outside throughout: by a token after its first, and by its ends.
        self.inner = max(0.0, (step[:2, :2] - step[2, 2]).max())
        leave, enter = max(0.0, (step[:2, 2] - step[2, 2]).max()), max(step[2, 0] - step[2, 2], first[0] - first[2])
        self.outer = enter + leave

    def _weights(self, place: str, string: str) -> np.ndarray:
        names = self.names[place]
        return self.model.emit[[names[name] for name in PLACES[place](string) if name in names]].sum(0)

    def _row(self, token: str) -> int:
        low = token.lower()
        if len(token) < 20 and token[1:].islower() and token.isalpha() and low not in self.vocabulary and not _hint.search(low):
            key: tuple = (len(token),)
        else:
            key = (tuple(own_features(token)), tuple(beside_features(token)[:2]), low if low in self.vocabulary else len(low) < 20, is_hint(token), size_class(token))
        if key not in self.rows:
            self.rows[key] = len(self.rows)
            self.token_rows.append((np.array([self._weights(place, token) for place in self.SIDES]), is_hint(token), size_class(token)))
        return self.rows[key]

    def emissions(self, tokens: list[str], gaps: list[str], files: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the states of each token, and whether it begins a line. A text ends with an empty token behind its last gap."""
        if len(self.tokens) > MOST_STRINGS or len(self.gaps) > MOST_STRINGS or len(self.rows) > MOST_STRINGS:
            self.__init__(self.model)
        coded, between = pa.array(tokens).dictionary_encode(), pa.array(gaps).dictionary_encode()
        known = self.tokens
        names = coded.dictionary.to_pylist()
        for x in names:
            if x not in known:
                known[x] = self._row(x)
        marks = between.dictionary.to_pylist()
        for x in marks:
            if x not in self.gaps:
                self.gaps[x] = len(self.gap_rows)
                self.gap_rows.append((self._weights("gap before", x), self._weights("gap after", x), is_assigned(x), "\n" in x))
        row = np.array([known[x] for x in names], np.int64)[coded.indices.to_numpy()]
        gap = np.array([self.gaps[x] for x in marks], np.int64)[between.indices.to_numpy()]
        before, behind, assigned, ends = (np.array(x) for x in zip(*self.gap_rows, strict=True))
        weights, hint, size = (np.array(x) for x in zip(*self.token_rows, strict=True))
        weights = np.ascontiguousarray(weights.transpose(1, 0, 2))
        empty = known[""]
        starts = ends[gap] | np.concatenate([[True], row[:-1] == empty])
        one = np.concatenate([[empty], row[:-1]])
        one[starts] = empty
        two = np.concatenate([[empty], one[:-1]])
        two[starts] = empty
        after = np.concatenate([row[1:], [empty]])
        after[:-1][starts[1:]] = empty
        out = files
        for place, where in enumerate((row, one, two, after)):
            out += weights[place].take(where, axis=0)
        around = (before[:, None] + behind).reshape(-1, 3)  # of each pair of gaps
        out += around.take(gap * len(before) + np.concatenate([gap[1:], gap[:1]]), axis=0) if len(around) < 1 << 16 else before[gap] + behind[np.concatenate([gap[1:], gap[:1]])]
        out += self.joint.reshape(-1, 3).take(16 * hint[one] + 8 * assigned[gap] + size[row], axis=0)
        out[row == empty] = (-1e4, -1e4, 0)
        return out, starts

    def tags(self, emit: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """First token and best states of each line that isn't outside throughout.

        A line is passed over when no token gains enough for any span to pay, which is what Viterbi would find.
        """
        gain = emit[:, :2].max(1) - emit[:, 2] + self.inner
        begins = np.flatnonzero(starts)
        total, most = np.add.reduceat(np.maximum(gain, 0), begins), np.maximum.reduceat(gain, begins)
        pays = np.where(most > 0, total, most) + self.outer > 0
        ends = np.concatenate([begins[1:], [len(emit)]])
        lines = list(zip(begins[pays].tolist(), ends[pays].tolist(), strict=True))
        for (a, _), states in zip(lines, best_paths([emit[a:b] for a, b in lines], self.model.step, self.model.first), strict=True):
            if states.min() < 2:
                yield a, states.tolist()

    def find(self, texts: list[str]) -> list[list[Span]]:
        """Base spans of each text, and those of the field that overlap none of them."""
        tokens, gaps, firsts, files = [], [], [], []
        for text in texts:
            pieces = pieces_of(text)
            firsts.append(len(tokens))
            tokens += pieces[1::2]
            tokens.append("")
            gaps += pieces[0::2]
            file = file_feature(text)
            if file not in self.files:
                self.files[file] = self.model.weight(["file: " + file])
            files.append(self.files[file])
        sizes = np.diff([*firsts, len(tokens)])
        emit, starts = self.emissions(tokens, gaps, np.repeat(np.array(files), sizes, axis=0))
        added: list[list[Span]] = [[] for _ in texts]
        which = np.repeat(np.arange(len(texts)), sizes)
        places: dict[int, np.ndarray] = {}
        for a, states in self.tags(emit, starts):
            of = int(which[a])
            if of not in places:
                low, high = firsts[of], firsts[of] + int(sizes[of])
                lengths = np.array([(len(g), len(t)) for g, t in zip(gaps[low:high], tokens[low:high], strict=True)]).ravel()
                places = {of: np.cumsum(lengths)}
            for k, state in enumerate(states, a - firsts[of]):
                begin, end = int(places[of][2 * k]), int(places[of][2 * k + 1])
                if state == 0:
                    added[of].append(("crf", begin, end))
                elif state == 1:
                    added[of][-1] = ("crf", added[of][-1][1], end)
        out = []
        for text, more in zip(texts, added, strict=True):
            base = base_spans(text)
            out.append(ordered(base + [s for s in more if all(s[2] <= a or b <= s[1] for _, a, b in base)]))
        return out


def find(model: Model, text: str) -> list[Span]:
    """Base spans, and those of the field that overlap none of them."""
    return Tagger(model).find([text])[0]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans array<struct<kind, start, end>>`` of each row's whole text, in code points, ends exclusive.

    Every token of a line is tagged. Null and empty texts have no spans. Null and repeated ids are kept, other columns left
    out; an empty table gives an empty one. Nothing is shuffled.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("spans", kind)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)

        def found() -> Iterator[tuple]:
            held, size = [], 0
            for key, raw in rows_of(batches):
                held.append((key, text_of(raw)))
                size += 8 + len(held[-1][1]) // 6
                if size >= GROUP:
                    yield from zip([k for k, _ in held], tagger.find([x for _, x in held]), strict=True)
                    held, size = [], 0
            if held:
                yield from zip([k for k, _ in held], tagger.find([x for _, x in held]), strict=True)

        rows = ((key, [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]) for key, spans in found())
        return batches_of(rows, schema)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return given.mapInArrow(run, "id long, spans array<struct<kind string, start long, end long>>").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the fixed kinds, the hash of their spans, and all spans as text."""

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(id_col, *map(count, KINDS[:3]), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
