"""Problem 4: broken prompt and response pairs.

Noisy labelling functions vote yes, no or not at all for every defect.  For each defect an
expectation-maximisation label model estimates, from the counts of the vote patterns alone,
how often the defect occurs and how far each function can be trusted, and gives each pattern
a posterior.  Labels are kept where the posterior reaches a cutoff validated on
defects planted into every sound pair; where one label is asked for, the highest posterior decides.

Only counts reach the driver: at most 3 ** functions patterns per defect, and the languages asked and spoken.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions import codepoints as cp
from coursemill.llm.canonical import canonical_string, canonicalize
from coursemill.operators.joins import guarded_join
from coursemill.session import materialize

ABSTAIN, YES, NO = 0, 1, 2
#: In the order in which equal posteriors are resolved.
DEFECTS = ("empty", "refusal", "copies_question", "other_language", "truncated")
#: A last word may be cut off if longer words that begin with it are so many times as frequent.
RARE_FACTOR = 8
#: Answers that are planted as empty ones and as refusals.
EMPTY_ANSWERS = ("", "略", "N/A", "Answer:", "<p></p>", "答：", "。")
REFUSALS = ("抱歉，我无法回答这个问题。", "Sorry, I can't help with that.", "这道题我不会做。", "I must decline to answer.")
#: So many characters mostly show that letters are not few.
SOME_LETTERS = 40
#: Answers that are longer are planted as truncated ones.
LONG_ANSWER = 60

#: Marks that stand for a missing answer, and labels without anything behind them.
NOTHING = set("略 无 空 待补充 待填 待定 暂无 未作答 没有 none null nil n/a na nan tbd todo empty blank pending nothing undefined".split())
LABEL = re.compile(r"^(?:题目问的是|参考答案|答案?|解答?|回答|题目|问题|原题|the question(?: asks| is)?|answer|question|solution|reply|response|q|a)\s*[:.、]?\s*", re.I)
#: Ways to decline.
DECLINE = re.compile(
    r"\b(?:i|i'm|i am|we|me)\b[^.。]{0,30}\b(?:can't|cannot|can not|unable|not able|won't|must decline|decline|refuse|not (?:permitted|allowed|authori[sz]ed)|don't have (?:the )?(?:permission|rights))"
    r"|\b(?:must|have to) decline|no answer can be|(?:outside|beyond) (?:of )?(?:(?:my|the) (?:scope|abilit|capabilit|reach)|what i)|not (?:supported|something i)|can't help|cannot help|not appropriate to"
    r"|我.{0,8}(?:无法|不能|不会|帮不了|没有足够|做不到|不方便)|帮不了你|恕难|恕不|不便(?:讨论|回答|透露)|不会做|超出.{0,10}(?:能力|范围)|不支持(?:处理|回答|解答)|拒绝(?:回答|作答)|无法(?:回答|解答|提供|协助)",
    re.I,
)
#: A text that declines holds one of these, in lower case; they are looked for first.
DECLINE_PARTS = ("can't", "cannot", "can not", "unable", "not able", "won't", "decline", "refuse", "not permitted", "not allowed", "not authori", "don't have", "no answer can be", "outside", "beyond", "not supported", "not something i", "not appropriate to", "我", "帮不了你", "恕", "不便", "不会做", "超出", "不支持", "拒绝", "无法")
#: No label is longer.
LONGEST_LABEL = 40
APOLOGY = re.compile(r"^(?:非常|很|十分)?(?:抱歉|对不起|遗憾|不好意思)|^作为一个|^你好|^(?:i'm |i am |we're )?(?:so |very )?(?:sorry|afraid)|^unfortunately|^apolog|^as an? [\w ]{0,30}assistant|^regrettably", re.I)
CORRECTION = re.compile(r"更正|改正|订正|correction|corrected|写反|should have been", re.I)
CORRECTION_PARTS = ("更正", "改正", "订正", "correct", "写反", "should have been")
#: Frequent words by language.
STOPWORDS = {
    "en": "the of and to is in that it for with on as at by not but from which this are be what why how does".split(),
    "de": "der die das und ist nicht mit von den dem ein eine auf für wird bei zu im sich auch wenn".split(),
    "fr": "le la les de des du et est un une que dans par pour qui sur dont puis avec ce".split(),
    "es": "el la los las de del y es un una que en por para con se su al cuando".split(),
    "it": "il lo la gli di del della e è un una che in per con si quando non".split(),
    "pt": "o os as de do da e é um uma que em por para com se quando não".split(),
}
#: Names of languages in requests.
NAMES = {"english": "en", "英文": "en", "英语": "en", "chinese": "zh", "中文": "zh", "汉语": "zh", "german": "de", "德文": "de", "德语": "de", "deutsch": "de", "french": "fr", "法文": "fr", "法语": "fr", "spanish": "es", "japanese": "ja", "日文": "ja", "日语": "ja", "russian": "ru", "俄文": "ru", "俄语": "ru"}
_NAMES = "|".join(NAMES)
#: All that language() tells, and those that can be asked for; positions are codes.
LANGUAGES = ("", "ja", "ko", "ru", "zh", *STOPWORDS)
NAMED = tuple(sorted(set(NAMES.values())))
ASKED = re.compile(rf"(?:用|以|要求|译成|翻译成|翻译为)\s*({_NAMES})|(?:in|into)\s+({_NAMES})\b|({_NAMES})\s*(?:回答|作答|表述|书写|answer|please)|\bauf ({_NAMES})\b", re.I)

CODE = re.compile(r"```.*?(?:```|$)", re.S)
FIGURES = re.compile(r"\d+")
WITHOUT_FIGURE = re.compile(r"\b[^\W\d]+\b")
LETTERS = re.compile(r"[^\W\d_]+")
TAG = re.compile(r"<[^<>]{0,40}>")
FORMULA = re.compile(r"\$[^$]*\$?")
IDEOGRAPH = re.compile(r"[一-鿿]+")
KANA = re.compile(r"[぀-ヿ]+")
HANGUL = re.compile(r"[가-힣]+")
CYRILLIC = re.compile(r"[Ѐ-ӿ]+")
SENTENCE_END = re.compile(r"(?:(?<!\.)\.|[。!?！？])[\"'”’」』)]*$")
EQUATION_END = re.compile(r"(?:=|≈|\babout|约|为|is)\s*[-+]?\d+(?:\.\d+)?\s*(?:°C?|%|[a-zA-ZμΩ°]{1,3}(?:/°?[a-zA-Z]{1,2})?)(?:\s*/\s*\w+)?$|^[-+]?\d+(?:\.\d+)?\s*[a-zA-ZμΩ%°]{0,3}$")
LIST_END = re.compile(r"^[^:。.]{1,14}:\s*[^.。:=]+(?:,\s*[^.。:=]+)*$")
NETLIST_LINE = re.compile(r"^[A-Z]{1,3}\d+(?: n\d+){2} \S+$")
DANGLING = re.compile(r"(?:[,，;；:：、+\-*/=(\[{\\<>&|]|…|\.\.\.|\\[a-z]+|\b(?:the|a|an|of|and|or|to|in|on|with|by|for|from|that|which|is|are|at|as|its|der|die|das|und|mit)|[的和与把从由在为到对将或及是令使其若当因])$")
#: What dangles is no longer, but for a run of signs, whose end is enough, or a command, which begins at the last backslash.
LONGEST_DANGLING = 8


#: By frequent word: the languages it is frequent in.
_FREQUENT: dict[str, list[str]] = {}
for _code, _words in STOPWORDS.items():
    for _word in set(_words):
        _FREQUENT.setdefault(_word, []).append(_code)


def _many(pattern: re.Pattern, text: str) -> int:
    """The number of characters in the runs of a pattern."""
    return sum(map(len, pattern.findall(text)))


def language(text: str) -> str:
    """The language of the prose of a text, or "" if there is too little of it."""
    prose = CODE.sub(" ", text) if "```" in text else text
    prose = FORMULA.sub(" ", prose) if "$" in prose else prose
    plain = prose.isascii()
    han, kana, hangul, cyrillic = (0, 0, 0, 0) if plain else (_many(x, prose) for x in (IDEOGRAPH, KANA, HANGUL, CYRILLIC))
    found = WITHOUT_FIGURE.findall(prose)
    words = [w for w in (chain.from_iterable(x.split("_") for x in found) if "_" in prose else found) if len(w) > 1 and (plain or w.isascii() or not IDEOGRAPH.search(w) and not CYRILLIC.search(w))]
    if kana >= 5 and kana * 4 >= han:
        return "ja"
    if hangul >= 8:
        return "ko"
    if cyrillic >= 10 and cyrillic >= 2 * han:
        return "ru"
    if han >= 6 and han >= len(words):
        return "zh"
    if len(words) < 5:
        return ""
    hits = dict.fromkeys(STOPWORDS, 0)
    for w in words:
        for code in _FREQUENT.get(w.lower(), ()):
            hits[code] += 1
    best = max(hits, key=hits.__getitem__)
    return best if hits[best] >= 2 else ""


@dataclass
class Asked:
    """What the votes look at in a question."""

    squeezed: str
    figures: set[str]
    language: str
    languages: set[str]  # that are asked for


@lru_cache(20_000)
def asked(question: str) -> Asked:
    q = squeeze(question)
    low = question.lower()
    named = {NAMES[x.lower()] for x in chain.from_iterable(ASKED.findall(question)) if x} if any(x in low for x in NAMES) else set()
    return Asked(q, set(FIGURES.findall(question)), language(question), named)


def grams(text: str) -> Iterable[tuple[str, ...]]:
    """The runs of four characters, or the whole of a shorter text."""
    return zip(text, text[1:], text[2:], text[3:]) if len(text) > 3 else [tuple(text)]


def squeeze(text: str) -> str:
    """Letters, figures and ideographs in lower case only."""
    return text.lower().translate(NO_WORD) if text.isascii() else "".join(WORD_OR_FIGURE.findall(text.lower()))


WORD_OR_FIGURE = re.compile(r"[^\W_]+", re.U)
#: The ASCII signs that it leaves out.
NO_WORD = {c: None for c in range(128) if not chr(c).isalnum()}


def vote_empty(answer: str, squeezed: str | None = None) -> list[int]:
    bare = TAG.sub("", answer) if "<" in answer else answer
    core = squeezed if squeezed is not None and bare is answer else squeeze(bare)
    if len(core) > LONGEST_LABEL:
        return [NO, NO, NO, NO]
    unlabelled = squeeze(LABEL.sub("", bare.strip(), count=1))
    mark = core in NOTHING or re.sub(r"[\s()（）\[\]<>.。]+", "", bare).lower() in NOTHING
    return [
        YES if not core else NO if unlabelled and not mark else ABSTAIN,
        YES if not core or mark or not unlabelled else NO,
        YES if not unlabelled else ABSTAIN if mark else NO,
        NO if len(core) > 12 else YES if mark or not unlabelled else ABSTAIN,
    ]


def vote_refusal(answer: str) -> list[int]:
    low = answer.lower()
    declines = any(x in low for x in DECLINE_PARTS) and bool(DECLINE.search(answer))
    first = bool(APOLOGY.match(answer.strip()))
    figures = _many(FIGURES, answer)
    corrects = any(x in low for x in CORRECTION_PARTS) and bool(CORRECTION.search(answer))
    return [
        YES if declines else NO,
        YES if first and not corrects else ABSTAIN,
        YES if declines and figures == 0 else NO if figures > 2 else ABSTAIN,
        NO if len(answer) > 220 or corrects else YES if declines else ABSTAIN,
    ]


def apart(questions: list[str], answers: list[str]) -> list[bool]:
    """For each pair of squeezed texts, whether under half of the grams of the answer are in the question, by hashes that can only find too many of them."""

    def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        if len(codes) < 4:
            return codes[:0], rows[:0]
        at = rows[:-3]
        runs = (((codes[:-3] << 16) ^ codes[1:-2]) << 16 ^ codes[2:-1]) << 16 ^ codes[3:]
        inside = at == rows[3:]
        mixed = (runs[inside] + at[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        return mixed >> np.uint64(42), at[inside]

    known = np.zeros(1 << 22, bool)
    known[places(questions)[0]] = True
    found, rows = places(answers)
    shared = np.bincount(rows, known[found], len(answers))
    return [n > 3 and 2 * x < n - 3 for n, x in zip(map(len, answers), shared.tolist())]


def vote_copy(question: str, answer: str, squeezed: str | None = None, differs: bool = False) -> list[int]:
    """The votes; differs says that under half of the squeezed answer is in the question (see apart)."""
    known, stripped = asked(question), answer.strip()
    q, bare = known.squeezed, LABEL.sub("", stripped, count=1)
    differs = differs and bare == stripped
    a = squeezed if squeezed is not None and bare == stripped else squeeze(bare)
    if not q or not a:
        return [ABSTAIN, NO, NO, NO]
    if a == q:  # nothing is left, and all of it is in the question
        return [YES, YES, YES, YES if known.figures.issuperset(FIGURES.findall(answer)) else NO]
    times = a.count(q)
    rest = squeeze(LABEL.sub("", stripped.replace("\n", " "), count=1)).replace(q, "") if times or "\n" in answer else a
    cover = 0.0 if differs else sum(map(set(grams(q)).__contains__, grams(a))) / max(1, len(a) - 3)
    only = times > 0 and len(rest) <= max(6, len(q) // 10)
    return [
        YES if a == q or (times and not rest) else NO,
        YES if only or (cover >= 0.9 and len(a) >= 0.6 * len(q)) else NO if cover < 0.6 or (times and len(rest) > 12) else ABSTAIN,
        YES if cover >= 0.85 and 0.6 <= len(a) / len(q) <= 1.35 else NO if cover < 0.5 else ABSTAIN,
        NO if (times and len(rest) > 12) or len(rest) > 1.5 * len(q) or not known.figures.issuperset(FIGURES.findall(answer)) else YES if cover >= 0.8 and len(a) >= 0.6 * len(q) else ABSTAIN,
    ]


def shares(answer: str) -> tuple[int, bool]:
    """How much of an answer is ideographs (0 under 0.15 of the letters, 2 over one half), and whether its letters are few."""
    han = 0 if answer.isascii() else _many(IDEOGRAPH, answer)
    prose = CODE.sub("", answer) if "```" in answer else answer
    prose = FORMULA.sub("", prose) if "$" in prose else prose
    if not han and _many(LETTERS, prose[:SOME_LETTERS]) >= 15:
        return 0, False
    letters = _many(LETTERS, prose) or 1
    return 0 if han / letters < 0.15 else 2 if han / letters > 0.5 else 1, letters < 15


def language_votes(q: str, languages: set[str], a: str, share: int, few: bool) -> list[int]:
    """The votes on an answer in a for a question in q that asks for languages."""
    if not q or not a:
        return [ABSTAIN, NO, ABSTAIN, NO]
    if a == q or a in languages:
        return [NO, NO, NO if a in languages else ABSTAIN, NO]
    foreign = share == 0 if q == "zh" else share == 2 if a == "zh" else True
    return [YES, YES if foreign else NO, ABSTAIN, NO if few else YES]


def vote_language(question: str, answer: str, spoken: str | None = None) -> list[int]:
    """The votes; spoken is the language of the answer where it is known."""
    known = asked(question)
    q, a = known.language, language(answer) if spoken is None else spoken
    differs = q and a and a != q and a not in known.languages
    return language_votes(q, known.languages, a, *(shares(answer) if differs else (0, False)))


def _unbalanced(text: str) -> bool:
    if text.count("```") % 2 or text.replace("```", "").count("$") % 2:
        return True
    return any(text.count(a) > text.count(b) for a, b in ("()", "[]", "{}", "（）", "「」", "“”"))


def vote_truncated(answer: str) -> tuple[list[int], str]:
    """The votes, and the last word where it may be a cut one ("" where it can't)."""
    text = answer.rstrip()
    if not WORD_OR_FIGURE.search(text):
        return [NO, ABSTAIN, ABSTAIN, NO], ""
    last = text.rsplit("\n", 1)[-1].strip()
    ended = bool(SENTENCE_END.search(text))
    closed = ended or text.endswith("```") and text.count("```") % 2 == 0 or (last.endswith("$") and last.count("$") % 2 == 0) or (text[-1] in ")）" and not _unbalanced(text))
    short = len(text) <= 30 and "\n" not in text and not re.search(r"[,，;；]", text)
    form = closed or bool(EQUATION_END.search(last)) or bool(LIST_END.search(last)) or bool(NETLIST_LINE.match(last)) and "```" not in text
    word = text[len(text.rstrip(ascii_letters)) :]
    tail = len(text) - LONGEST_DANGLING
    tail = max(0, min(tail, text.rfind("\\")) if "\\" in text else tail)
    return [
        NO if closed or short else ABSTAIN if form else YES,
        YES if DANGLING.search(text, tail) and not (ended and not text.endswith("...")) else ABSTAIN,
        YES if _unbalanced(text) else ABSTAIN if not ended else NO,
        NO if form or short else YES,
    ], word.lower() if word and not short and not closed and not EQUATION_END.search(last) else ""


def votes(question: str, answer: str, spoken: str | None = None, squeezed: str | None = None, differs: bool = False) -> tuple[dict[str, list[int]], str]:
    """The votes by defect, and the last word where it may be a cut one; what is known of the answer need not be found again."""
    truncated, word = vote_truncated(answer)
    squeezed = squeeze(answer) if squeezed is None else squeezed
    return {
        "empty": vote_empty(answer, squeezed),
        "refusal": vote_refusal(answer),
        "copies_question": vote_copy(question, answer, squeezed, differs),
        "other_language": vote_language(question, answer, spoken),
        "truncated": truncated,
    }, word


def encode(vote: list[int]) -> int:
    code = 0
    for v in vote:
        code = code * 3 + v
    return code


def decode(code: int, functions: int) -> list[int]:
    out = []
    for _ in range(functions):
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


class LabelModel:
    """Expectation-maximisation over vote patterns of one defect: two classes, functions independent given the class."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> None:
        self.patterns, self.counts = patterns, counts.astype(float)
        yes, no = (patterns == YES).sum(1), (patterns == NO).sum(1)
        self.posterior = np.clip((yes + 0.05) / (yes + no + 0.1 + 0.5 * (yes == 0)), 0.02, 0.98)
        for _ in range(rounds):
            before = self.posterior
            self._maximise(smooth)
            self.posterior = self.predict(patterns)
            if np.abs(before - self.posterior).max() < 1e-9:
                break

    def _maximise(self, smooth: float) -> None:
        weight = np.stack((self.counts * (1 - self.posterior), self.counts * self.posterior))
        self.prior = (weight.sum(1) + smooth) / (weight.sum() + 2 * smooth)
        functions = self.patterns.shape[1]
        self.table = np.empty((2, functions, 3))
        for f in range(functions):
            for v in range(3):
                self.table[:, f, v] = (weight * (self.patterns[:, f] == v)).sum(1) + smooth
        self.table /= self.table.sum(2, keepdims=True)

    def predict(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)[:, None] + sum(np.log(self.table[:, f, patterns[:, f]]) for f in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def validated_cutoff(self, planted: np.ndarray, planted_counts: np.ndarray, clean: np.ndarray, clean_counts: np.ndarray) -> float:
        """The least posterior, one half or more, with the best F1 on planted defects among clean rows (both given as vote patterns with counts).

        Clean rows are weighted as the model's prior has it; without planted rows the expected F1 decides.
        """
        planted_rows, clean_rows = float(np.sum(planted_counts)), float(np.sum(clean_counts))
        if not planted_rows or not clean_rows:
            return self.cutoff()
        hit, false = self.predict(planted), self.predict(clean)
        weight = self.prior[0] / self.prior[1] * planted_rows / clean_rows
        best, at = -1.0, 0.5
        for limit in np.unique(np.concatenate(([0.5], hit[hit >= 0.5], false[false >= 0.5]))):
            kept = planted_counts[hit >= limit].sum()
            f1 = 2 * kept / (kept + weight * clean_counts[false >= limit].sum() + planted_rows)
            if f1 > best + 1e-9:
                best, at = float(f1), float(limit)
        return at

    def cutoff(self) -> float:
        """The posterior from which labels are kept: the best expected F1, never under one half."""
        order = np.argsort(-self.posterior)
        kept, hit, total = 0.0, 0.0, float((self.counts * self.posterior).sum())
        best, at = -1.0, 1.0
        for i in order:
            kept += self.counts[i]
            hit += self.counts[i] * self.posterior[i]
            f1 = 2 * hit / (kept + total) if kept + total else 0.0
            if f1 > best:
                best, at = f1, float(self.posterior[i])
        return max(0.5, at)


def question_and_answer(requests: DataFrame) -> DataFrame:
    """(request_id, q, a): content stands for a blank question; nulls are empty."""
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    question = F.when(blank, F.coalesce("content", F.lit(""))).otherwise(F.col("question"))
    return requests.select("request_id", question.alias("q"), F.coalesce("answer", F.lit("")).alias("a")).where("request_id IS NOT NULL")


def sound(found: dict[str, list[int]]) -> bool:
    """Whether the votes on a pair leave it fit for planting: no two functions say yes to a defect."""
    return not any(v.count(YES) > 1 for v in found.values())


@lru_cache(20_000)
def copied(question: str) -> int | None:
    """The vote code of a copy of a question in one of four forms, None where there is nothing to copy."""
    if not asked(question).squeezed:
        return None
    forms = (question, f"题目:{question}", question.upper(), f"{question}\n{question}")
    return encode(vote_copy(question, forms[zlib.crc32(question.encode()) % len(forms)]))


def cut_off(question: str, answer: str) -> tuple[int | None, str]:
    """The vote code and the last word of a long answer that ends early; the place is drawn from the texts, so it is the same in every run."""
    if len(answer) <= LONG_ANSWER:
        return None, ""
    first, last = len(answer) // 3, len(answer) - 10
    at = first + zlib.crc32(f"{question}\n{answer}".encode()) % (last - first + 1)
    vote, word = vote_truncated(answer[:at].rstrip(" .。!?！？"))
    return encode(vote), word


def asks_code(question: str) -> int:
    """The language of a question and those it asks for as one number."""
    known = asked(question)
    return LANGUAGES.index(known.language) << len(NAMED) | sum(1 << i for i, x in enumerate(NAMED) if x in known.languages)


def speaks_code(answer: str, spoken: str) -> int:
    """The language of an answer and its shares as one number, 0 where there is no language."""
    share, few = shares(answer) if spoken else (0, False)
    return LANGUAGES.index(spoken) * 6 + share * 2 + few


def foreign_answers(asks: dict[int, int], speaks: dict[int, int]) -> Counter:
    """Vote codes with expected counts when each question gets each answer in a language that is neither its own nor asked for alike often.

    asks and speaks are the rows of each asks_code and speaks_code; there are at most len(LANGUAGES) << len(NAMED)
    and len(LANGUAGES) * 6 codes, so all pairs of all rows are met by their kinds.
    """
    out: Counter = Counter()
    for ask, questions in asks.items():
        q, languages = LANGUAGES[ask >> len(NAMED)], {x for i, x in enumerate(NAMED) if ask >> i & 1}
        others = {s: n for s, n in speaks.items() if LANGUAGES[s // 6] not in {"", q, *languages}} if q else {}
        total = sum(others.values())
        for s, n in others.items():
            out[encode(language_votes(q, languages, LANGUAGES[s // 6], s % 6 // 2, bool(s % 2)))] += questions * n / total
    return out


def vote_rows(requests: DataFrame) -> DataFrame:
    """(request_id, one vote code per defect, word, planted) of every request, once.

    requests has request_id, question, content, answer.  The question is content where question
    is blank; null answers count as empty ones.  planted is null but for sound pairs, and has
    the vote codes of a copy of the question and of a cut answer (null where there is none), the last word of
    the cut answer, and the codes of the languages.
    """
    rows = question_and_answer(requests)
    planted = {"copied": pa.int32(), "cut_off": pa.int32(), "cut_word": pa.string(), "asks": pa.int32(), "speaks": pa.int32()}
    fields = ", ".join(f"{c}: {'string' if t == pa.string() else 'int'}" for c, t in planted.items())
    schema = f"request_id {requests.schema['request_id'].dataType.simpleString()}, {', '.join(f'{d} int' for d in DEFECTS)}, word string, planted struct<{fields}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cp.row_slices(batch, "a"):
                questions, answers = (cp.unflatten(*canonicalize(*cp.flatten(part.column(i)))).to_pylist() for i in (1, 2))
                codes: dict[str, list[int]] = {d: [] for d in DEFECTS}
                words, whole, plants = [], [], []
                squeezed = [squeeze(x) for x in answers]
                differ = apart([asked(x).squeezed for x in questions], squeezed)
                for question, answer, core, differs in zip(questions, answers, squeezed, differ):
                    spoken = language(answer)
                    found, word = votes(question, answer, spoken, core, differs)
                    words.append(word)
                    for defect, vote in found.items():
                        codes[defect].append(encode(vote))
                    whole.append(sound(found))
                    plants.append((copied(question), *cut_off(question, answer), asks_code(question), speaks_code(answer, spoken)) if whole[-1] else (None,) * len(planted))
                columns = [pa.array(values, kind) for values, kind in zip(zip(*plants), planted.values())]
                struct = pa.StructArray.from_arrays(columns, list(planted), mask=pa.array([not x for x in whole]))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(codes[d], pa.int32()) for d in DEFECTS), pa.array(words, pa.string()), struct], names=["request_id", *DEFECTS, "word", "planted"])

    return rows.mapInArrow(run, schema).groupBy("request_id", *DEFECTS, "word").agg(F.min("planted").alias("planted"))


def rare_words(requests: DataFrame, last: DataFrame) -> DataFrame:
    """The last words that may be cut: longer words that begin with them are RARE_FACTOR times as frequent in the answers.

    A word and its longer ones grow alike with the table, so the same answer gets the same vote at every size.
    """
    words = requests.select(F.explode(F.regexp_extract_all(F.lower("answer"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = materialize(words, "words")
    some = last.where("word <> ''").select("word").distinct()
    parts = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", F.lit(1), i))
    longer = words.where(F.length("word") > 1).select(F.explode(parts).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("longer"))
    return some.join(words, "word").join(longer, "word").where(F.col("n") * RARE_FACTOR <= F.col("longer")).select("word")


def label_defects(requests: DataFrame) -> DataFrame:
    """(request_id, defect, posterior): every label whose posterior reaches the cutoff of its defect; a request may have several.

    The label models and the cutoffs are made from counts over all requests: each sound pair is one
    clean row and has each defect planted once (truncated if it is long, other_language by the languages of all sound pairs).
    """
    functions = {d: len(v) for d, v in votes("", "")[0].items()}
    functions["truncated"] += 1
    rows = materialize(vote_rows(requests), "votes")
    cuts = rows.where("planted.cut_off IS NOT NULL").groupBy(F.col("planted.cut_word").alias("word"), F.col("planted.cut_off").alias("code")).agg(F.count("*").alias("n"))
    cuts = materialize(cuts, "cuts")
    cut = materialize(rare_words(requests, rows.select("word").union(cuts.select("word"))).withColumn("cut", F.lit(YES)), "rare-words")
    with_cut = lambda df, code: guarded_join(df, cut, ["word"], "left").withColumn(code, F.col(code) * 3 + F.coalesce("cut", F.lit(ABSTAIN))).drop("cut")
    rows = with_cut(rows, "truncated")
    shapes = [F.struct(F.lit(d).alias("defect"), F.col(d).alias("code")) for d in DEFECTS]
    kinds = [F.struct(F.lit(k).alias("defect"), F.col(f"planted.{k}").alias("code")) for k in ("copied", "asks", "speaks")]
    seen = rows.select(F.explode(F.array(*shapes, *kinds)).alias("v"), F.col("planted").isNotNull().cast("int").alias("sound")).where("v.code IS NOT NULL")
    counts: dict[str, dict[int, tuple[int, int]]] = {}
    # At most 3 ** functions codes a defect, and as many of languages as foreign_answers says.
    for r in seen.groupBy("v.defect", "v.code").agg(F.count("*").alias("n"), F.sum("sound").alias("clean")).collect():
        counts.setdefault(r.defect, {})[r.code] = (r.n, r.clean)
    clean_rows = sum(n for _, n in counts.get(DEFECTS[0], {}).values())
    of_all = lambda kind: {c: n for c, (n, _) in counts.get(kind, {}).items()}
    planted: dict[str, dict[int, float]] = {
        "empty": Counter(),
        "refusal": Counter(),
        "copies_question": of_all("copied"),
        "other_language": foreign_answers(of_all("asks"), of_all("speaks")),
        "truncated": {r.code: r.n for r in with_cut(cuts, "code").groupBy("code").agg(F.sum("n").alias("n")).collect()},
    }
    for defect, vote, phrases in (("empty", vote_empty, EMPTY_ANSWERS), ("refusal", vote_refusal, REFUSALS)):
        for phrase in phrases:  # their votes look at the answer alone, so each phrase stands for an equal part of all sound pairs
            planted[defect][encode(vote(canonical_string(phrase)))] += clean_rows / len(phrases)
    kept = []
    for defect in DEFECTS:
        mine = sorted(counts.get(defect, {}).items())
        if not mine:
            continue
        arrays = lambda pairs: (np.array([decode(c, functions[defect]) for c, _ in pairs], int).reshape(-1, functions[defect]), np.array([n for _, n in pairs], float))  # noqa: B023, E731
        patterns, numbers = arrays([(c, n) for c, (n, _) in mine])
        model = LabelModel(patterns, numbers)
        limit = model.validated_cutoff(*arrays(sorted(planted[defect].items())), *arrays([(c, n) for c, (_, n) in mine if n]))
        kept += [(defect, c, float(p)) for (c, _), p, x in zip(mine, model.posterior, patterns) if p >= limit and (x == YES).any()]
    labels = requests.sparkSession.createDataFrame(kept, "defect string, code int, posterior double")
    long = rows.select("request_id", F.explode(F.array(*shapes)).alias("v")).select("request_id", "v.defect", "v.code")
    return long.join(F.broadcast(labels), ["defect", "code"]).select("request_id", "defect", F.round("posterior", 3).alias("posterior"))


def find_defects(requests: DataFrame) -> DataFrame:
    """(request_id, defect): the requests whose answer is no usable one, with their one defect.

    Of several labels the one with the highest posterior counts, equal ones in the order of DEFECTS.
    """
    rank = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    best = label_defects(requests).groupBy("request_id").agg(F.max(F.struct("posterior", (-rank).alias("rank"), "defect")).alias("best"))
    return best.select("request_id", F.col("best.defect").alias("defect"))
