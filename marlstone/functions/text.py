"""Text as Spark expressions: cleaning, headings, sentences, numbers, tokens, answers.

Terminators and token patterns are parameters; the defaults suit Chinese financial text, the
LATIN preset suits the driver's tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that carry no meaning.
STOP_TOKENS = "的 了 和 与 及 或 在 是 为 对 以 等 中 上 下 之 其 该 本 第 条 款 项 者 。 ， 、 ； ： （ ） 《 》 “ ” ？ ! ? . , ; :".split()
# Numerals as digits.
NUMERALS = {"零": "0", "〇": "0", "一": "1", "二": "2", "两": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9", "十": "10"}
# Terms that tie neighbouring sentences together.
BRIDGE_TERMS = "同比 环比 增长 下降 上升 增加 减少 变化 占比 比例 率 金额 规模 年度 季度 平均 净利润 营业收入 现金流 资产负债 研发投入 分红".split()
# Terms too general to be evidence, and negations.
GENERIC_TERMS = "公司 数据 情况 相关 内容 方面 信息 主要 其中 说明 报告 文件 项目 业务 产品 指标 部分 方式".split()
NEGATIONS = "不 无 未 不得 不能 除外 仅".split()
# Number patterns of the evidence signature and of the re-ranker.
NUMBER = r"\d[\d.]*%?"
OPTION_NUMBER = r"\d[\d.%]*"
# Openings of headings.
HEADING = (
    r"^(?:第[一二三四五六七八九十百千万0-9]+[章节条款]|[一二三四五六七八九十]+、|[0-9]{1,2}(?:\.[0-9]+)*[、.]|"
    r"（[一二三四五六七八九十0-9]+）|[A-Z][、.]|(?:目录|摘要|风险提示|重大事项|发行条款|财务情况|附录|定义与解释).{0,40})"
)
# What marks an answer, denies all options, and says that an option holds or doesn't.
ANSWER_MARK = "答案|正确选项|answer"
NO_OPTION = "无|没有|都不|均.*错|全部错|不选|none"
HOLDS_NOT, HOLDS = "不成立|错误|不正确|否|false|错", "成立|正确|是|true|对"
OPTION_LINE = r"^\s*([A-Da-d])\s*[:：-]\s*(.+)"
ANSWER_CHARS = 40


@dataclass(frozen=True)
class Preset:
    """How a language's text is cut: sentence ends (a character class body) and the token pattern."""

    ends: str = "。！？!?；;"
    token: str = r"[A-Za-z0-9.%]+|[一-鿿]{2}"
    term: str = r"[A-Za-z0-9.%]+|[一-鿿]{2,}"

    @property
    def sentence(self) -> str:
        return f"[^{self.ends}]+[{self.ends}]?"


CHINESE = Preset()
LATIN = Preset(ends=".!?", token=r"[\p{L}0-9%]+", term=r"[\p{L}0-9%]+")


def clean(text: Column) -> Column:
    """Runs of blanks to one, three or more newlines to two, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def is_heading(paragraph: Column) -> Column:
    """Whether a trimmed paragraph of at most 100 characters opens like a heading."""
    p = F.trim(paragraph)
    return (F.length(p) > 0) & (F.length(p) <= 100) & p.rlike(HEADING)


def sentences(text: Column, preset: Preset = CHINESE) -> Column:
    """Trimmed sentences with their ends."""
    found = F.regexp_extract_all(text, F.lit(f"({preset.sentence})"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def normal_numbers(text: Column) -> Column:
    """Thousands separators and blanks inside numbers go; a written percentage becomes ``N%``."""
    out = F.regexp_replace(text, r"[,，](?<=[0-9].)(?=[0-9])", "")
    out = F.regexp_replace(out, r"\s(?<=[0-9]\s)\s*(?=[0-9万亿元%])", "")
    for word, digit in NUMERALS.items():
        out = F.replace(out, F.lit(f"百分之{word}"), F.lit(f"{digit}%"))
    return out


def tokens(text: Column, preset: Preset = CHINESE) -> Column:
    """Tokens in order, repeats kept, stop tokens gone, numbers normalised first."""
    return plain_tokens(normal_numbers(text), preset)


def plain_tokens(plain: Column, preset: Preset = CHINESE) -> Column:
    """Tokens of a text whose numbers are normal already."""
    found = F.regexp_extract_all(plain, F.lit(f"({preset.token})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(STOP_TOKENS))


def numbers(text: Column, pattern: str = NUMBER) -> Column:
    return F.regexp_extract_all(normal_numbers(text), F.lit(f"({pattern})"), F.lit(1))


def signature(text: Column, preset: Preset = CHINESE) -> Column:
    """struct(terms, numbers, negations): what a text can be evidence of."""
    terms = F.array_distinct(F.filter(tokens(text, preset), lambda t: (F.length(t) >= 2) & ~t.isin(GENERIC_TERMS)))
    return F.struct(terms.alias("terms"), F.array_distinct(numbers(text)).alias("numbers"), F.filter(terms, lambda t: t.isin(NEGATIONS)).alias("negations"))


def unescaped(text: Column) -> Column:
    """Character references, named (HTML 4) and numeric, as characters; unknown ones stay as they are."""
    names = F.create_map(*[F.lit(x) for k, v in {**{k: chr(c) for k, c in name2codepoint.items()}, "apos": "'", "nbsp": " "}.items() for x in (k, v)])

    def read(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("int")
        known = (digits > 0) & (digits < 0x110000) & ~digits.between(0xD800, 0xDFFF)
        char = F.when(name.startswith("#"), F.when(known, F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(names, name))
        return F.coalesce(F.concat(char, F.substring(piece, F.length(name) + 2, F.length(piece))), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), read), ""))


def html_text(html: Column) -> Column:
    """Text of HTML: script, style, nav, header, footer and comments go, tags become newlines."""
    out = html
    for tag in ("script", "style", "nav", "header", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "\n")
    out = unescaped(F.regexp_replace(out, r"(?s)<[^>]*>", "\n"))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", "")


def answer_letters(text: Column, valid: str = "ABCD") -> Column:
    """Letters of the answer after the last answer marker (40 characters), else of the last line.

    A segment that denies all options gives none. Letters are distinct, in order of appearance.
    """
    t = F.coalesce(text, F.lit(""))
    # Everything up to the last marker goes; where there is none, up to the last newline.
    marked = F.regexp_extract(t, rf"(?is)^.*(?:{ANSWER_MARK})\s*[:：]?(.*)$", 1)
    has = t.rlike(f"(?i){ANSWER_MARK}")
    segment = F.when(has, F.substring(marked, 1, ANSWER_CHARS)).otherwise(F.element_at(F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\r?\n"), -1))
    none = segment.rlike(f"(?i){NO_OPTION}")
    letters = F.regexp_extract_all(F.upper(segment), F.lit("([A-Z])"), F.lit(1))
    return F.when(none, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(letters, lambda c: F.lit(valid).contains(c))))


def structured_letters(text: Column, valid: str = "ABCD") -> Column:
    """Letters of lines ``A: holds``; where no line decides, answer_letters. A later line overrules."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    def read(line: Column) -> Column:
        tail = F.regexp_extract(line, OPTION_LINE, 2)
        holds = F.when(tail.rlike(f"(?i){HOLDS_NOT}"), F.lit(False)).when(tail.rlike(f"(?i){HOLDS}"), F.lit(True))
        return F.struct(F.upper(F.regexp_extract(line, OPTION_LINE, 1)).alias("letter"), holds.alias("holds"))

    told = F.filter(F.transform(lines, read), lambda x: x["holds"].isNotNull() & (x["letter"] != "") & F.lit(valid).contains(x["letter"]))
    last = lambda c: F.element_at(F.filter(told, lambda x: x["letter"] == c), -1)["holds"]
    has = lambda c: F.exists(told, lambda x: x["letter"] == c)
    kept = F.filter(F.array(*[F.lit(c) for c in valid]), lambda c: F.when(has(c), last(c)).otherwise(F.lit(False)))
    return F.when(F.size(told) > 0, kept).otherwise(answer_letters(text, valid))
