"""Text functions that need positions: coverage of a query by a passage, and cause evidence. Arrow-batched."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_COVERAGE, WINDOW, SPAN = 0.6, 5, 160
_TOKEN = re.compile(r"[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)*|[㐀-鿿]+|[.!?。！？;；\n]")


def gram(query: str) -> int:
    """Length of the Han units of a query: 2 if its runs have at most 4 characters, else 3."""
    return 2 if all(len(r) <= 4 for r in re.findall(r"[㐀-鿿]+", query)) else 3


def units(text: str, n: int) -> list[list[tuple[str, int, int]]]:
    """Units with offsets, per sentence: words and ids, and n-grams of Han runs."""
    out: list[list[tuple[str, int, int]]] = [[]]
    for m in _TOKEN.finditer(unicodedata.normalize("NFKC", text).lower()):
        t, a = m[0], m.start()
        if t in ".!?。！？;；\n":
            out.append([])
        elif "㐀" <= t[0] <= "鿿":
            out[-1] += [(t[i : i + n], a + i, a + i + n) for i in range(max(1, len(t) - n + 1))]
        else:
            out[-1].append((t, a, a + len(t)))
    return out


def coverage(query: str | None, text: str | None) -> float:
    """Most distinct query units within 5 successive units and 160 characters of one sentence, over min(5, units); queries of at
    most 3 units must match in full."""
    n = gram(query or "")
    wanted = {u for s in units(query or "", n) for u, _, _ in s}
    if not wanted or not text:
        return 0.0
    need, best = min(WINDOW, len(wanted)), 0.0
    for sentence in units(text, n):
        for i, (_, first, _) in enumerate(sentence):
            seen: set[str] = set()
            for u, _, end in sentence[i : i + WINDOW]:
                if end - first > SPAN:
                    break
                if u in wanted:
                    seen.add(u)
            best = max(best, len(seen) / need)
    best = min(1.0, best)
    return best if len(wanted) > 3 or best == 1.0 else 0.0


# The closed form of a question for a cause, and what makes an answer no plain statement.
CAUSE_WORD, CAUSE_LIMITS = "原因", (64, 100_000, 160)
_CAUSE_TOKEN = re.compile(r"[㐀-鿿豈-﫿a-z0-9]{2,24}")
_CAUSE_ANSWER = re.compile(r"[㐀-鿿豈-﫿a-z0-9]{2,64}")
_CAUSE_DOUBT = re.compile(r"[不未无尚待吗么呢]|可能|或许|什么|是否|并非|暂缺|调查中|猜测|否认")
_SENTENCE = re.compile(r"([^。！？!?\r\n\u2028\u2029]+)([。！？!?\r\n\u2028\u2029]*)")


def _asked_words(query: str | None) -> list[str]:
    """The words of a question for a cause: four to eight, of which the last says so; else none."""
    text = unicodedata.normalize("NFKC", query or "").lower().strip()
    words = re.split(r"[ \t]+", text)
    fits = 4 <= len(words) <= 8 and words[-1] == CAUSE_WORD and len(text) <= CAUSE_LIMITS[0] and all(map(_CAUSE_TOKEN.fullmatch, words))
    return words if fits else []


def cause_sentence(query: str | None, text: str | None) -> str | None:
    """The sentence of a text, as it stands there, that states the cause that is asked for: all words in their order, joined by nothing but
    在 or 的, then the cause and a short plain answer. Questions and doubtful answers state nothing."""
    words = _asked_words(query)
    if not words or not text or len(text) > CAUSE_LIMITS[1]:
        return None
    stated = re.compile("(?:在|的)?".join(map(re.escape, words[:-1])) + "[,，]?" + CAUSE_WORD + "(?:为|是|在于|包括|[:：])(.+)")
    forms = [unicodedata.normalize("NFKC", c) for c in text]
    origin = [i for i, f in enumerate(forms) for _ in f] + [len(text)]
    for m in _SENTENCE.finditer("".join(forms)):
        compact = re.sub(r"[ \t]", "", m[1].lower())
        found = stated.fullmatch(compact) if "?" not in m[2] and "？" not in m[2] and len(compact) <= CAUSE_LIMITS[2] else None
        if found and _CAUSE_ANSWER.fullmatch(found[1]) and not _CAUSE_DOUBT.search(found[1]):
            return text[origin[m.start()] : origin[m.end()]].strip() or None
    return None


@F.pandas_udf(T.DoubleType())
def lexical_coverage(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([coverage(q, t) for q, t in zip(query, text)])


@F.pandas_udf(T.StringType())
def cause_evidence(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([cause_sentence(q, t) for q, t in zip(query, text)])


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


# Fixed values of the question for a falling product in a quarter's report: its words, the columns of the table, what makes a text unsure.
_QUARTERS = "一二三四"
_DRAFT = re.compile(r"未经|未确认|未证实|待核实|待验证|假设|草稿|模拟|猜测|作废|撤回|已否认|不明确")
_GUESS = re.compile(r"预计|预测|否认")
_UNSURE = re.compile(r"[不未无尚待吗么呢?？]|可能|或许|是否|并非|暂缺|调查中|猜测|否认")
_THIS_TABLE = re.compile(r"上述表格|该表|本表|上述报告|该报告|本报告")
_RULE = re.compile(r":?-{3,}:?")
REPORT_LIMITS = (64, 100_000, 200)


@dataclass
class _Asked:
    product: str
    model: str
    rival: str
    quarter: int
    year: str


def _report_question(query: str | None) -> _Asked | None:
    """product model rival quarter 销售下滑 yearQn 财报, or nothing."""
    text = unicodedata.normalize("NFKC", query or "").lower().strip()
    m = re.fullmatch(r"([㐀-鿿]{2,24})[ \t]+([a-z][a-z0-9]{1,23})[ \t]+([㐀-鿿]{2,24})[ \t]+([一二三四])季度[ \t]+销售下滑[ \t]+(20\d{2})q([1-4])[ \t]+财报", text)
    if not m or len(text) > REPORT_LIMITS[0] or _QUARTERS.index(m[4]) + 1 != int(m[6]):
        return None
    return _Asked(m[1], m[2], m[3], int(m[6]), m[5])


def _cells(line: str) -> list[str]:
    t = line.strip()
    return [c.strip() for c in t[1:-1].split("|")] if len(t) > 1 and t[0] == t[-1] == "|" else []


def _headings_fit(asked: _Asked, headings: list[str]) -> bool:
    """The first heading names the period, and none speaks of another one or of guesses."""
    han = _QUARTERS[asked.quarter - 1]
    if not headings or not re.search(rf"{asked.year}年?第?{han}季度|{asked.year}\s*q{asked.quarter}|q{asked.quarter}\s*{asked.year}", headings[0]):
        return False
    for h in headings:
        quarters = [int(d) if d else _QUARTERS.index(c) + 1 for d, c in re.findall(r"q([1-4])|第?([一二三四])季度", h)]
        if _DRAFT.search(h) or _GUESS.search(h) or set(re.findall(r"20\d{2}", h)) - {asked.year} or set(quarters) - {asked.quarter}:
            return False
    return True


def _row_verdict(asked: _Asked, row: list[str]) -> bool | None:
    """Whether a row proves the fall (True) or speaks against it (False); None if it is about something else."""
    if not re.fullmatch(rf"{asked.product}\s+{asked.model}", row[0]):
        return None
    falls = re.fullmatch(r"-\d+(?:\.\d+)?%", row[2]) and float(row[2][:-1]) < 0
    stated = re.fullmatch(rf"主要受{asked.rival}竞争影响(?:[;；].{{1,64}})?", row[3])
    return bool(falls and stated and not _DRAFT.search(row[3]) and not _UNSURE.search(row[3]))


def quarter_excerpt(query: str | None, text: str | None) -> str | None:
    """Heading, header and row of the report's table that proves why a product fell in a quarter; null without such a table, with rows that
    disagree, or where the text takes the table back."""
    asked = _report_question(query)
    if asked is None or not text or len(text) > REPORT_LIMITS[1]:
        return None
    raw = re.split(r"\r?\n", text)
    lines = [unicodedata.normalize("NFKC", x).lower() for x in raw]
    header = ["产品", f"q{asked.quarter}销售额", "固定汇率同比", "官方披露的主要原因"]
    # the headings above, each with whether text may still qualify what follows, and whether it did
    above: list[list] = []
    for i, line in enumerate(lines[:-2]):
        h = re.fullmatch(r"(#{1,6})\s+(.+)", line)
        if h:
            level = len(h[1])
            above = [[x[0], x[1], x[2], False, x[4]] for x in above if x[0] < level]
            above.append([level, h[2], raw[i], True, False])
            continue
        cells = _cells(line)
        if cells:
            above = [[*x[:3], False, x[4]] for x in above]
        elif _DRAFT.search(line):
            above = [[*x[:4], x[4] or x[3]] for x in above]
        rooted = bool(above) and above[0][0] == 1
        if cells != header or any(x[4] for x in above) or not rooted or not _headings_fit(asked, [x[1] for x in above]):
            continue
        rule = _cells(lines[i + 1])
        if len(rule) != 4 or not all(map(_RULE.fullmatch, rule)):
            continue
        end, proofs, shown, against = i + 2, set(), None, False
        while end < len(lines):
            row = _cells(lines[end])
            if len(row) != 4 or row[0] == header[0] or all(map(_RULE.fullmatch, row)):
                break
            verdict = _row_verdict(asked, row)
            against |= verdict is False
            if verdict:
                proofs.add("|".join(row))
                excerpt = "\n".join((above[0][2], raw[i], raw[end]))
                shown = shown or (excerpt if len(excerpt) <= REPORT_LIMITS[2] else None)
            end += 1
        note = []
        for x in lines[end:]:
            if re.match(r"#{1,6}\s", x) or _cells(x):
                break
            note.append(x)
        taken_back = any(map(_DRAFT.search, note)) or any(_DRAFT.search(x) and _THIS_TABLE.search(x) for x in lines[end:])
        if shown and not against and len(proofs) == 1 and not taken_back:
            return shown
    return None


@F.pandas_udf(T.StringType())
def quarter_evidence(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([quarter_excerpt(q, t) for q, t in zip(query, text)], dtype=object)
