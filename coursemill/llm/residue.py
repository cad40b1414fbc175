"""Problem 8: template residue and error-page text.

Every line of the corpus is a message.  A fixed-depth prefix tree mines the templates the lines
belong to: its levels are the number of tokens and the first DEPTH tokens, figures and
identifiers being wildcards; in a leaf, templates that are alike but for one run of tokens are
merged, with wildcards where the members differ.  For each template it is counted how often it
stands alone, that is in a document with hardly any other prose; templates that mostly do are
classified once, by a classifier fitted on labelled examples of messages (llm.messages) and on
lines of texts with prose, and the verdict is propagated to all their lines
and so to the documents.  A sentence that only writes about errors or scripts stands among
other prose, so its template is never a verdict.  Unresolved slots are detected separately,
also inside ordinary text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions import codepoints as cp
from coursemill.llm import messages
from coursemill.llm.canonical import canonicalize
from coursemill.llm.linear import LineClassifier, repetition
from coursemill.llm.sampling import bounded_sample
from coursemill.llm.tokens import FIGURE, IDEOGRAPH, _classes
from coursemill.operators.joins import guarded_join, salted_join
from coursemill.session import materialize

#: Depth of the prefix tree in leading tokens, below its level for the number of tokens.
DEPTH = 4
#: Templates of a leaf are merged where they differ in one run of at most so many tokens, and in no more than half of all.
RUN = 3
#: The classifier is fitted on the examples and on about so many documents (at most twice as many), of which it takes so many pieces of lines.
SAMPLE_ROWS = 200
SAMPLE_PIECES = 2_000
PIECE_CHARS = 60
#: A template is a message of a kind from this posterior on.
LEAST_POSTERIOR = 0.5
#: One under this posterior cannot be one with others merged to it either.
CANDIDATE = 0.2
#: Longer runs of letters and figures are no words but data.
BLOB_CHARS = 100
#: A line stands alone if the other prose of its document has at most so many characters.
ALONE_CHARS = 160
#: A template is classified if so large a part of its lines stands alone.
ALONE_PART = 0.5
#: Dummy text takes the place of content from so large a part of the other prose on.
FILLER_PART = 0.3

#: Names of slots.
_NAME = r"(?:[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z_]\w*)*|[一-鿿][一-鿿\w]{0,15})"
#: The ways to write an unfilled slot.
SLOTS = [
    r"\{\{\s*%s\s*\}\}" % _NAME,
    r"\{%%\s*(?:block|include|if|for|url|trans)\s+%s\s*%%\}" % _NAME,
    r"<%%[=-]?\s*%s\s*%%>" % _NAME,
    r"\[\[\s*%s\s*\]\]" % _NAME,
    r"@@%s@@" % _NAME,
    r"(?<![A-Za-z0-9_])__%s__(?![A-Za-z0-9_])" % r"(?:[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*|[一-鿿]{1,12})",
    r"%%\(%s\)[sdf]" % _NAME,
    r"(?:TODO|FIXME|TBD)\(%s\)" % _NAME,
    r"【(?:请填写|请输入|待填写|此处填写)\s*%s】" % _NAME,
    r"<%s(?:待补充|待填写|待定)>" % r"[\w.一-鿿]{1,24}?",
    r"\[(?:insert|your|enter|add)\s+%s(?:\s+here)?\]" % _NAME,
    r"«\s*%s\s*»" % _NAME,
    r"\$\{%s\}" % r"(?:[a-z][A-Za-z0-9_]*(?:\.[A-Za-z_]\w*)*|[一-鿿][一-鿿\w]{0,15})",
    r"(?<![A-Za-z0-9#&])#%s#(?![A-Za-z0-9#])" % r"(?:[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*|[一-鿿]{1,12})",
    r"(?<![A-Za-z0-9_\\^}{$%%@#])\{%s\}(?!\})" % r"(?:[a-z][a-z0-9]*(?:[_.][a-z0-9]+)+|[a-z]{4,20}|[一-鿿][一-鿿\w]{0,15})",
]
SLOT = re.compile("|".join(SLOTS))
#: Words of a sentence that writes about slots instead of leaving one unfilled.
ABOUT_SLOTS = re.compile(r"标记|模板|占位符|变量名|宏|语法|printf|template|placeholder|\bmarks (?:such|like|in|of)\b|\bmacro|syntax|variable", re.I)
#: A slot can only begin with one of these.
OPENERS = "{<[@_%TF【«$#"
#: Lines of content and of the frame of a page are no messages.
KINDS = ("content", "frame", "error_page", "filler", "script_notice")
MESSAGES = 2
NEWLINE, VARIABLE = 0x0A, 0x5BD1E995
#: Signs that end a sentence, and those that may follow them at the end of a line.
STOPS = "。！？.!?”…"
LINE_SCHEMA = "doc_id {key}, path long, template long, n long, chars int, alone boolean, prose int, slot boolean, line string"


@dataclass
class Lines:
    """The lines with content of a batch: their row, place in points, tokens, and the hash of their characters."""

    points: np.ndarray
    low: np.ndarray  # points in lower case, any digit as 0
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    tokens: np.ndarray  # hashes of the tokens of all lines, variable ones alike
    first: np.ndarray  # by line: its first token
    last: np.ndarray
    same: np.ndarray  # by line: hash of its characters


def parse_lines(points: np.ndarray, offsets: np.ndarray) -> Lines:
    """The lines of texts in the consistent form.  Blank lines are left out."""
    kinds, lower = _classes()
    kind = kinds[points]
    low = np.where(kind == FIGURE, np.uint32(ord("0")), lower[points])
    feeds = np.flatnonzero(points == NEWLINE)
    start = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    end = np.sort(np.concatenate((feeds, offsets[1:])), kind="stable")
    visible = np.concatenate(([0], np.cumsum((points > 0x20) & (points != 0x3000))))
    full = visible[end] > visible[start]
    start, end = start[full], end[full]
    row = np.searchsorted(offsets, start, "right") - 1
    group = np.where(kind == IDEOGRAPH, 2, (kind > 0).astype(np.int8))
    change = np.ones(len(points) + 1, bool)
    change[1:-1] = (group[1:] != group[:-1]) | (group[1:] == 2)
    change[offsets] = True
    edges = np.flatnonzero(change)
    begins, ends = edges[:-1], edges[1:]
    real = group[begins] > 0 if len(begins) else np.zeros(0, bool)
    begins, ends = begins[real], ends[real]
    figures = np.concatenate(([0], np.cumsum(kind == FIGURE)))
    tokens = cp.RunHasher(low)(begins, ends)
    tokens[figures[ends] > figures[begins]] = VARIABLE
    return Lines(points, low, row, start, end, tokens, np.searchsorted(begins, start), np.searchsorted(begins, end), cp.RunHasher(points)(start, end))


def tree_place(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """By line, the leaf of the prefix tree and the template in it."""
    run = cp.RunHasher(lines.tokens)
    size = (lines.last - lines.first).astype(np.uint64)
    leaf = cp.mix(run(lines.first, np.minimum(lines.first + DEPTH, lines.last)) * np.uint64(31) + size)
    return leaf, run(lines.first, lines.last)


def is_sentence(lines: Lines) -> np.ndarray:
    """Lines of prose: longer than 15 characters, with the end of a sentence at their end or inside."""
    stop = np.isin(lines.points, [ord(c) for c in STOPS])
    blank = (lines.points == 0x20) | (lines.points == 0x3000)
    at = np.maximum(lines.end - 1, 0)
    for _ in range(3):
        at = np.where((at > lines.start) & blank[at], at - 1, at)
    inner = lines.points == ord("。")
    if len(lines.points) > 1:
        inner[:-1] |= (lines.points[:-1] == ord(".")) & (lines.points[1:] == 0x20)
    inner = np.concatenate(([0], np.cumsum(inner)))
    return (lines.end - lines.start > 15) & (stop[at] | (inner[lines.end] > inner[lines.start]))


def often_in_row(lines: Lines, least: int = 3) -> np.ndarray:
    """Lines that stand at least so often in their text."""
    key = cp.mix(lines.same ^ cp.mix(lines.row.astype(np.uint64)))
    _, back, many = np.unique(key, return_inverse=True, return_counts=True)
    return many[back] >= least if len(key) else np.zeros(0, bool)


def kinds_of(model: LineClassifier, lines: Lines) -> np.ndarray:
    """The posteriors of all lines; a line that is no sequence of words (over BLOB_CHARS characters a token) is content."""
    out = model.posteriors(lines.low, lines.start, lines.end, repetition(lines.tokens, lines.first, lines.last))
    out[lines.end - lines.start > BLOB_CHARS * (lines.last - lines.first)] = np.eye(len(KINDS))[0]
    return out


def other_prose(lines: Lines, rows: int, dummy: np.ndarray) -> np.ndarray:
    """By line, the characters of prose in the other lines of its text; dummy lines and lines repeated in the text are none."""
    own = np.where(is_sentence(lines) & ~often_in_row(lines) & ~dummy, lines.end - lines.start, 0)
    return np.bincount(lines.row, own, rows)[lines.row].astype(np.int64) - own


def flat_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return canonicalize(*cp.flatten(pa.array(texts, pa.string())))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", examples: dict[str, list[str]] | None = None) -> LineClassifier:
    """The classifier, fitted on the examples by kind and on the lines of texts with prose in a bounded sample."""
    sample = bounded_sample(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length(text) > ALONE_CHARS), SAMPLE_ROWS)
    return train([r["t"] for r in sample], examples)


def train(texts: list[str], examples: dict[str, list[str]] | None = None) -> LineClassifier:
    """The classifier from texts of content and examples of messages."""
    points, offsets = flat_texts(texts)
    content = parse_lines(points, offsets)
    prose = np.where(is_sentence(content) & ~often_in_row(content), content.end - content.start, 0)
    among = np.flatnonzero(np.bincount(content.row, prose, len(texts))[content.row] > ALONE_CHARS)
    again = repetition(content.tokens, content.first, content.last)
    cut = [(a, min(a + PIECE_CHARS, int(content.end[i])), i) for i in among for a in range(int(content.start[i]), int(content.end[i]), PIECE_CHARS)]
    cut = [cut[i] for i in np.argsort(cp.mix(np.arange(len(cut), dtype=np.uint64)), kind="stable")[:SAMPLE_PIECES]]
    pieces, labels, repeated = [content.low[a:b] for a, b, _ in cut], [0] * len(cut), [again[[i for *_, i in cut]]]
    for at, kind in enumerate(KINDS[1:], 1):
        one = parse_lines(*flat_texts((examples or {}).get(kind) or messages.examples(kind)))
        pieces += [one.low[a:b] for a, b in zip(one.start, one.end)]
        labels += [at] * len(one.row)
        repeated.append(repetition(one.tokens, one.first, one.last))
    size = np.array([len(p) for p in pieces])
    ends = np.cumsum(size)
    return LineClassifier(KINDS).train(np.concatenate(pieces), ends - size, ends, np.concatenate(repeated), np.array(labels))


def has_slot(text: str) -> bool:
    """Whether an unfilled slot stands in the text, other than in a line that writes about slots or in a formula."""
    for m in SLOT.finditer(text):
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        line = text[start : end if end >= 0 else len(text)]
        before = text[start : m.start()]
        if before.count("$") % 2 and not m.group().startswith("$"):
            continue  # inside a formula
        rest = line.replace(m.group(), " ")
        if not ABOUT_SLOTS.search(SLOT.sub(" ", rest)):
            return True
    return False


def mine_lines(df: DataFrame, model: LineClassifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines as (leaf, template): one row each where they stand alone, with the line; else one row per batch with their number n.

    A row with slot set for each document with unfilled slots.  Null and empty texts give no rows.
    """
    opener = np.zeros(0x110000, bool)
    opener[[ord(c) for c in OPENERS]] = True
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cp.row_slices(batch, "text"):
                points, offsets = canonicalize(*cp.flatten(part.column(1)))
                seen = np.concatenate(([0], np.cumsum(opener[points])))[offsets]
                maybe = np.flatnonzero(seen[1:] > seen[:-1])
                texts = cp.unflatten(points, offsets).take(pa.array(maybe)).to_pylist()
                slots = maybe[[has_slot(x) for x in texts]] if len(maybe) else maybe
                lines = parse_lines(points, offsets)
                leaf, template = tree_place(lines)
                dummy = shared.value.contrast("filler", "content", lines.low, lines.start, lines.end, repetition(lines.tokens, lines.first, lines.last)) > 0
                others = other_prose(lines, part.num_rows, dummy)
                alone = np.flatnonzero(others <= ALONE_CHARS)
                _, first, many = np.unique(template[others > ALONE_CHARS], return_index=True, return_counts=True)
                rest = np.flatnonzero(others > ALONE_CHARS)[first]
                at = np.concatenate((alone, rest))
                kept = [points[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(lines.start[alone], lines.end[alone])]
                n, m = len(at), len(slots)
                take = pa.array(np.concatenate((lines.row[alone], np.zeros(len(rest), int), slots)).astype(np.int64), mask=np.concatenate((np.zeros(len(alone), bool), np.ones(len(rest), bool), np.zeros(m, bool))))
                flag = lambda x, y: pa.array(np.concatenate((np.full(len(alone), x), np.zeros(len(rest), bool), np.full(m, y))))  # noqa: B023,E731
                number = lambda x: pa.array(np.concatenate((x, np.zeros(m, x.dtype))))  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take), number(leaf[at].view(np.int64)), number(template[at].view(np.int64)), number(np.concatenate((np.ones(len(alone), np.int64), many)).astype(np.int64)),
                        number((lines.end - lines.start)[at].astype(np.int32)), flag(True, False), number(others[at].astype(np.int32)), flag(False, True), pa.array([*kept, *[None] * (len(rest) + m)], pa.string()),
                    ],
                    names=["doc_id", "path", "template", "n", "chars", "alone", "prose", "slot", "line"],
                )

    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    return rows.mapInArrow(run, LINE_SCHEMA.format(key=df.schema[key].dataType.simpleString()))


def wildcard_keys(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): by line and run of up to RUN tokens below the levels of the tree, a key of all but that run.

    Lines of one leaf with a common key are alike but for the run, which is at most half of the line.
    """
    run = cp.RunHasher(lines.tokens)
    leaf, _ = tree_place(lines)
    out_line, out_key = [], []
    for width in range(1, RUN + 1):
        size = lines.last - lines.first
        many = np.where(size >= 2 * width, np.maximum(size - DEPTH - width + 1, 0), 0)
        which = np.repeat(np.arange(len(size)), many)
        at = lines.first[which] + DEPTH + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        before, after = run(lines.first[which], at), run(at + width, lines.last[which])
        out_line.append(which)
        out_key.append(cp.mix(cp.mix(before * np.uint64(31) + after) ^ leaf[which] ^ cp.mix((at - lines.first[which]).astype(np.uint64) * np.uint64(RUN + 1) + np.uint64(width))))
    return np.concatenate(out_line), np.concatenate(out_key)


def merge_leaves(templates: DataFrame) -> DataFrame:
    """(template, merged): the templates of each leaf joined where they are alike but for one run of tokens; merged is the smallest of them.

    templates has template and line, a sample of it.  Every template goes to the smallest one it
    shares a key with, twice over, so chains of two steps meet; one without such stays itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cp.row_slices(batch, "line"):
                lines = parse_lines(*canonicalize(*cp.flatten(part.column(1))))
                which, keys = wildcard_keys(lines)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(lines.row[which])), pa.array(keys.view(np.int64))], names=["template", "key"])

    keys = materialize(templates.select("template", "line").mapInArrow(run, "template long, key long").distinct(), "residue-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = materialize(salted_semi(keys, shared), "residue-shared")
    merged = keys.select("template").distinct().withColumn("merged", F.col("template"))
    for _ in range(2):
        labels = keys.join(merged, "template").groupBy("key").agg(F.min("merged").alias("merged"))
        merged = salted_join(keys, labels, ["key"]).groupBy("template").agg(F.min("merged").alias("merged"))
    return merged


def salted_semi(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with one of the keys; both have key, and the rows of one key are spread."""
    return salted_join(rows, keys, ["key"], "left_semi")


def judged(templates: DataFrame, model: LineClassifier) -> DataFrame:
    """templates with kind, the likeliest kind of message of each, and p, the posterior that it is a message, where that is CANDIDATE or more.

    A line with a slot is a form and no message.
    """
    known = templates.sparkSession.sparkContext.broadcast(model)
    schema = "path long, template long, n long, alone long, line string, kind string, p double"
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cp.row_slices(batch, "line"):
                one = parse_lines(*canonicalize(*cp.flatten(part.column("line"))))
                post = kinds_of(known.value, one)
                best, p = post[:, MESSAGES:].argmax(1) + MESSAGES, post[:, MESSAGES:].sum(1)
                hit = np.flatnonzero(p >= CANDIDATE)
                texts = part.column("line").take(pa.array(one.row[hit])).to_pylist()
                hit = hit[[SLOT.search(x) is None for x in texts]] if len(hit) else hit
                kept = part.take(pa.array(one.row[hit]))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in columns[:5]), pa.array([KINDS[k] for k in best[hit]], pa.string()), pa.array(p[hit])], names=columns)

    return templates.select(*columns[:5]).mapInArrow(run, schema)


def classify_templates(lines: DataFrame, model: LineClassifier) -> DataFrame:
    """(template, kind): templates that mostly stand alone and are messages.

    Every template is classified once, by its smallest line, so the verdict is the same however the rows are
    partitioned.  Those that may be messages are merged within their leaves; the counts of
    merged templates are added up, their posteriors averaged over the lines that stand alone.
    """
    stats = lines.where("NOT slot").groupBy("path", "template").agg(F.sum("n").alias("n"), F.sum(F.col("alone").cast("long")).alias("alone"), F.min("line").alias("line")).where("alone > 0")
    stats = materialize(judged(stats, model), "residue-templates")
    full = stats.groupBy("path").agg(F.count("*").alias("members")).where("members > 1").select("path")  # leaves with one template have nothing to merge
    merged = merge_leaves(guarded_join(stats.select("path", "template", "line"), full, ["path"], "left_semi"))
    joined = stats.join(merged, "template", "left").withColumn("merged", F.coalesce("merged", "template"))
    groups = joined.groupBy("merged").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone"), F.sum(F.col("p") * F.col("alone")).alias("p"), F.max_by("kind", F.struct("alone", "template")).alias("kind"))
    picked = groups.where((F.col("alone") >= ALONE_PART * F.col("n")) & (F.col("p") >= LEAST_POSTERIOR * F.col("alone"))).select("merged", "kind")
    return joined.select("template", "merged").join(picked, "merged").select("template", "kind")


def find_residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind): documents with unfilled slots, dummy text, error messages or demands for scripts where content should be.

    A document whose messages of one kind have no fewer characters than its other prose (for dummy
    text FILLER_PART of it) is of that kind; among several kinds of messages the one with most characters counts, ties go by name.
    A document may have a slot besides.  Null and empty texts have no kind.
    """
    model = fit(df, key, text)
    lines = materialize(mine_lines(df, model, key, text), "residue-lines")
    verdicts = classify_templates(lines, model)
    hits = guarded_join(lines.where("alone").select("doc_id", "template", "chars", "prose", "line"), materialize(verdicts, "residue-verdicts"), ["template"])
    own = F.col("prose")
    per_kind = hits.groupBy("doc_id", "kind").agg(F.sum("chars").alias("chars"), F.min(own).alias("prose"))
    best = per_kind.groupBy("doc_id").agg(F.max_by(F.struct("kind", "prose"), F.struct("chars", "kind")).alias("b"), F.max("chars").alias("chars"))
    least = F.when(F.col("b.kind") == "filler", FILLER_PART).otherwise(1.0) * F.col("b.prose")
    messages = best.where(F.col("chars") >= least).select("doc_id", F.col("b.kind").alias("kind"))
    slots = lines.where("slot").select("doc_id", F.lit("placeholder").alias("kind"))
    return messages.unionByName(slots).distinct().withColumnRenamed("doc_id", key)


def without_residue(df: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """df without the found documents."""
    return df.join(found.select(key).distinct(), key, "left_anti")
