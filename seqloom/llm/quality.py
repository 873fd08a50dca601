"""Per-document text quality statistics, and the documents that aren't natural prose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.prose import prose_chars_of_cells, solid
from seqloom.llm.rules import induce, to_case
from seqloom.session import slices

#: At most about so many labelled documents train the rules, and half as many more measure them.
TRAIN_ROWS = 6000
#: Characters of text that are measured at once, unless a single text is longer.
PART_CHARS = 4_000_000

# Lines by their form: list items, headings, quotes and commands; items side by side; code. A line of fewer than SHORT words is a
# short one, of LONG and more a long one. All others without these forms are the text's body.
_MARKED = r"^\s*([-*+•–|#<>%!$@{\[]|\d{1,3}[.)]\s)"
_SIDE_BY_SIDE = r" [|>] |\t"
_CODE = r"[={}\\^~]|\w\[|\w\("
SHORT, LONG = 4, 8
_END = r"[.!?…。！？][\"')\]”»*_`]*$"
_SUMS = ["n_lines", "n_punct_lines", "n_words", "n_solid", "n_signs", "n_digits", "n_common", "n_distinct", "n_capitals", "n_commas", "n_sentences", "n_ideographs"]
_LINES = ["marked", "side", "code", "short", "long", "punct", "common"]
_BODY = ["n_lines", "n_punct_lines", "n_words", "n_solid", "n_common", "n_distinct", "n_capitals", "n_sentences"]
FEATURES = [
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punct_line_share", "common_word_share", "distinct_word_share", "capital_word_share", "comma_rate", "words_per_line", "words_per_sentence", "ideograph_share",
    *(f"{n}_line_chars" for n in _LINES), "body_share", "body_word_length", "body_words_per_line", "body_words_per_sentence", "body_punct_line_share", "body_common_word_share", "body_distinct_word_share", "body_capital_word_share",
]


def _unwrapped(texts: pa.Array) -> pa.Array:
    """Texts without the wrapping of a notebook's layout: cells as JSON objects, or as comments."""

    def where(texts: pa.Array, mark: str, *changes: tuple) -> pa.Array:
        has = pc.match_substring(texts, mark)
        if not pc.any(has).as_py():
            return texts
        part = texts.filter(has)
        for change, pattern, by in changes:
            part = change(part, pattern=pattern, replacement=by)
        return pc.replace_with_mask(texts, has, part)

    plain, regex = pc.replace_substring, pc.replace_substring_regex
    json = [(regex, r'\{"cell_type": "\w+", "source": \[', "\n"), (plain, '\\n", "', "\n"), (plain, '\\n"]', '"]'), (plain, '"]}', "\n"), (plain, "\\n", "\n"), (plain, '\\"', '"')]
    return where(where(texts, '"cell_type"', *json), "# %%", (regex, "(?m)^# ?", ""))


def _sums(texts: pa.Array, common: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text: _SUMS over all lines, the non-blank characters in lines of each form, and _BODY over the body's lines."""
    n = len(texts)
    lines = pc.split_pattern(_unwrapped(texts), "\n")
    doc, line = pc.list_parent_indices(lines).to_numpy(), lines.flatten()
    words = pc.utf8_split_whitespace(line)
    at, word = pc.list_parent_indices(words).to_numpy(), words.flatten()
    some = pc.greater(pc.binary_length(word), 0)
    at, word = at[some.to_numpy(zero_copy_only=False)], word.filter(some)
    flag = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    of_line = lambda x: np.bincount(at, x, len(line))
    # what is in a word is counted once for each distinct one
    coded = word.dictionary_encode()
    kinds, code = coded.dictionary, coded.indices.to_numpy()
    found = lambda pattern: of_line(pc.count_substring_regex(kinds, pattern).to_numpy(zero_copy_only=False)[code])
    lower = pc.utf8_lower(kinds)
    is_common = flag(pc.is_in(pc.utf8_trim(lower, characters=".,;:!?()\"'"), value_set=common))[code]
    capital, ends, comma = (flag(x)[code] for x in (pc.match_substring_regex(kinds, r"^\p{Lu}"), pc.match_substring_regex(kinds, _END), pc.ends_with(kinds, ",")))
    size, count, ideographs = of_line(pc.utf8_length(kinds).to_numpy(zero_copy_only=False)[code]), of_line(None), found("[぀-ヿ㐀-鿿]")
    stops = found("[。！？]")
    per_line = {
        "n_lines": (count > 0).astype(float), "n_words": count, "n_solid": size, "n_signs": found(r"[^\p{L}\p{N}\s]"), "n_digits": found(r"\d"), "n_common": of_line(is_common), "n_capitals": of_line(capital),
        "n_commas": of_line(comma), "n_sentences": np.maximum(of_line(ends), stops), "n_ideographs": ideographs,
    }
    last = np.zeros(len(line), bool)
    last[at[ends & np.r_[at[1:] != at[:-1], True][: len(at)]]] = True
    per_line["n_punct_lines"] = last.astype(float)
    long_enough = (count >= SHORT) | (ideographs >= LONG)  # ideographs have no blanks between them
    form = {"marked": flag(pc.match_substring_regex(line, _MARKED)), "side": flag(pc.match_substring_regex(line, _SIDE_BY_SIDE)), "code": flag(pc.match_substring_regex(line, _CODE)), "short": ~long_enough}
    body = ~np.logical_or.reduce(list(form.values()))
    form |= {"long": count >= LONG, "punct": last, "common": ~form["marked"] & (per_line["n_common"] >= 2)}
    # distinct words of each text, and of its body
    pairs = doc[at].astype(np.int64) << 32 | lower.dictionary_encode().indices.to_numpy()[code].astype(np.int64)
    distinct = lambda p: np.bincount(pd.unique(p) >> 32, minlength=n)
    of_doc = lambda x: np.bincount(doc, x, n)
    out = {c: of_doc(v) for c, v in per_line.items()} | {"n_distinct": distinct(pairs)} | {f"{c}_chars": of_doc(size * f) for c, f in form.items()}
    return out | {f"body_{c}": of_doc(per_line[c] * body) for c in _BODY if c in per_line} | {"body_n_distinct": distinct(pairs[body[at]])}


def quality_statistics(df: DataFrame, doc_id: str, text: str, common: list[str]) -> DataFrame:
    """One row a row of df: doc_id and FEATURES.

    common: the common words, all languages together; a fixed list. A word is a run of non-blank characters, a line counts if it isn't blank. Next to the
    counts over the whole text there are the shares of its non-blank characters in lines of each form (marked, side by side, code, short, long, ending in
    punctuation, with two common words and more), and the same measures of its body, the lines of none of the first four forms. Layouts of notebooks are
    unwrapped before, but for n_words and the shares' whole. Ratios are null for null, empty and blank texts, and where there is nothing to divide by; n_words is
    0 then. A text's sums are made by vectorised Arrow functions in the tasks that read it; nothing is shuffled.
    """
    listed = sorted({w.lower() for w in common if w})
    sums = [*_SUMS, *(f"{c}_chars" for c in _LINES), *(f"body_{c}" for c in _BODY), "whole_words", "whole_solid"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(listed, pa.string())
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for i, j in slices(pc.utf8_length(texts).to_pylist(), PART_CHARS):
                part = texts.slice(i, j - i)
                s = _sums(part, known)
                whole = pc.utf8_split_whitespace(part)
                at, size = pc.list_parent_indices(whole).to_numpy(), pc.utf8_length(whole.flatten()).to_numpy()
                s |= {"whole_words": np.bincount(at, size > 0, j - i), "whole_solid": np.bincount(at, size, j - i)}
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(s[c].astype(np.int64)) for c in sums)], names=["id", *sums])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.mapInArrow(measure, "id long, " + ", ".join(f"{n} long" for n in sums))
    ratio = lambda a, b: F.expr(f"try_divide({a}, {b})")
    both = lambda p: [
        ratio(f"{p}n_solid", f"{p}n_words").alias(f"{p}mean_word_length"), ratio(f"{p}n_punct_lines", f"{p}n_lines").alias(f"{p}punct_line_share"), ratio(f"{p}n_common", f"{p}n_words").alias(f"{p}common_word_share"),
        ratio(f"{p}n_distinct", f"{p}n_words").alias(f"{p}distinct_word_share"), ratio(f"{p}n_capitals", f"{p}n_words").alias(f"{p}capital_word_share"), ratio(f"{p}n_words", f"{p}n_lines").alias(f"{p}words_per_line"),
        ratio(f"{p}n_words", f"greatest({p}n_sentences, 1)").alias(f"{p}words_per_sentence"),
    ]
    forms = [ratio(f"{c}_chars", "whole_solid").alias(f"{c}_line_chars") for c in _LINES]
    shares = [ratio(a, "n_solid").alias(b) for a, b in (("n_signs", "symbol_ratio"), ("n_digits", "digit_ratio"), ("n_ideographs", "ideograph_share"))]
    out = rows.select(F.col("id").alias(doc_id), "whole_words", *both(""), *both("body_"), *forms, *shares, ratio("n_commas", "n_words").alias("comma_rate"), ratio("body_n_solid", "whole_solid").alias("body_share"))
    return out.withColumnsRenamed({"whole_words": "n_words", "body_mean_word_length": "body_word_length"}).select(doc_id, *FEATURES)


def label_documents(df: DataFrame, doc_id: str, text: str, cells: str, common: list[str], *, rows: int = TRAIN_ROWS * 3 // 2) -> DataFrame:
    """doc_id and is_junk of a bounded sample of about `rows` of the documents that have a text and cells.

    A document is junk if prose in its cells makes up less than half of the non-blank characters of its text; cells of code have none, and the other cells'
    paragraphs are told by `prose`. So labels need the recorded cells, which the statistics don't see. The sample is by a hash of doc_id, the same in every run.
    """
    words = frozenset(w.lower() for w in common if w)
    kept = df.where(F.col(f"`{cells}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull())
    part = min(1.0, rows / max(kept.count(), 1))
    kept = kept.where(F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).limit(2 * rows).repartition(16)  # limit leaves one task

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, prose_chars_of_cells(t, c, words) * 2 < solid(t)) for i, t, c in zip(*(x.to_pylist() for x in b.columns)) if t and not t.isspace()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([j for _, j in out], pa.bool_())], names=["id", "is_junk"])

    labelled = kept.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{cells}`").alias("cells")).mapInArrow(label, "id long, is_junk boolean")
    return labelled.withColumnRenamed("id", doc_id)


def learn_rules(statistics: DataFrame, labels: DataFrame, doc_id: str) -> tuple[str, dict[str, float]]:
    """The SQL CASE expression, over the columns of quality_statistics, that tells junk, and how it does on a third of the labelled documents that it
    wasn't learned from: n, precision and recall (NaN where there is nothing to count).

    The labelled rows, few by construction, come to the driver. Ratios that are null count as -1. Without labelled junk nothing is junk.
    """
    seen = statistics.join(F.broadcast(labels.dropDuplicates([doc_id])), doc_id).where("n_words > 0")  # bounded by the sample
    rows = seen.select(F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(3)).alias("third"), "is_junk", *FEATURES).fillna(-1, FEATURES).toPandas()
    rows = rows.sort_values(FEATURES, kind="stable")  # whatever the order they came in
    held = (rows["third"] == 0).to_numpy()
    x, y = rows[FEATURES].to_numpy(float), rows["is_junk"].to_numpy(bool)
    rules = induce(x[~held], y[~held])
    told = np.zeros(int(held.sum()), bool)
    for r in rules:
        told |= np.logical_and.reduce([c.holds(x[held]) for c in r])
    true = y[held]
    share = lambda a, b: float((a & b).sum() / b.sum()) if b.any() else float("nan")
    return to_case(rules, FEATURES), {"n": int(held.sum()), "precision": share(true, told), "recall": share(told, true)}


def not_prose(statistics: DataFrame, case: str) -> DataFrame:
    """The rows of the statistics that the rules tell as junk; texts without a non-blank character are none."""
    return statistics.where("n_words > 0").fillna(-1, FEATURES).where(F.expr(case))
