"""Translation of messages: a dictionary of whole texts, then patterns with parameters, then the text itself."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Messages with parameters, the first that matches counts. A parameter in braces is any text, one named count, done, total, start or end is a number.
MESSAGES = (
    "{name} 状态检查中",
    "{name} 就绪",
    "{name} 启动中",
    "{name} 启动失败",
    "{name} 待启动",
    "{name} 未就绪",
    "{name} 还没有就绪，请稍后再试。",
    "正在读取 {count} 个文件...",
    "{done}/{total} 解析中",
    "{done}/{total} 可继续",
    "解析失败：{detail}",
    "Office 已转 PDF · {name}",
    "第 {start} 页",
    "第 {start}-{end} 页",
    "{name} 超过上传上限 {limit}，请压缩或拆分后再试。",
    "不支持的文件格式：{name}",
    "确定要删除“{name}”吗？当前操作不可回撤。",
    "保存本地任务失败：{detail}",
    "读取本地任务失败：{detail}",
    "清空本地任务失败：{detail}",
    "删除本地任务失败：{detail}",
    "保存源文件失败：{detail}",
    "Office 转 PDF 失败：{detail}",
    "读取 PDF 分页失败：{detail}",
    "读取源文件失败：{detail}",
)
NUMBERS = ("count", "done", "total", "start", "end")
#: Messages of a name and a state, whose state is translated alone.
STATES = 6
_PARAMETER = re.compile(r"\{([a-zA-Z0-9_]+)\}")


class Messages:
    """A dictionary of whole texts and templates. An automaton of the longest literal part of each template tells which may match a text."""

    def __init__(self, dictionary: dict[str, str], templates: Sequence[str] = MESSAGES, states: int = STATES):
        self.dictionary, self.templates, self.states = dictionary, templates, states
        self.patterns, parts = [], {}
        for number, template in enumerate(templates):
            literals = _PARAMETER.split(template)[::2]
            parts.setdefault(max(literals, key=len), []).append(number)
            pattern = re.escape(literals[0])
            for name, literal in zip(_PARAMETER.findall(template), literals[1:], strict=True):
                pattern += (r"([0-9]+)" if name in NUMBERS else "([^\n\r\u2028\u2029]+)") + re.escape(literal)
            self.patterns.append(re.compile(pattern))
        self.always = sorted(parts.pop("", []))
        self.automaton = ahocorasick.Automaton()
        for literal, numbers in parts.items():
            self.automaton.add_word(literal, numbers)
        if parts:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Templates whose literal part is in the text, in order."""
        found = {number for _, numbers in (self.automaton.iter(text) if len(self.automaton) else ()) for number in numbers}
        return sorted(found.union(self.always))

    def of(self, text: str | None) -> str | None:
        """The dictionary's text, or that of the first template that matches, its parameters filled in, or the text as it is."""
        if text is None or self.dictionary.get(text):
            return text and self.dictionary[text]
        for number in self.candidates(text):
            match = self.patterns[number].fullmatch(text)
            if match:
                template = self.templates[number]
                if number < self.states:
                    state = template.partition("} ")[2]
                    return f"{match[1]} {self.dictionary.get(state) or state}"
                given = dict(zip(_PARAMETER.findall(template), match.groups(), strict=True))
                return _PARAMETER.sub(lambda m: given.get(m[1], m[0]), self.dictionary.get(template) or template)
        return text


def translated(rows: DataFrame, column: str, dictionary: dict[str, str], templates: Sequence[str] = MESSAGES, states: int = STATES, into: str = "translated") -> DataFrame:
    """``rows`` with ``into``: the translation of a column's texts. Texts that no template's literal part is in never meet a pattern.

    The dictionary and the templates are those of an interface, so they go with the task; null stays null.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        messages = Messages(dictionary, templates, states)
        for batch in batches:
            known: dict[str | None, str | None] = {}
            yield pa.array([known[t] if t in known else known.setdefault(t, messages.of(t)) for t in batch.to_pylist()], pa.string())

    return rows.withColumn(into, run(F.col(column)))
