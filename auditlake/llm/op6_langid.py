"""Language identification as inference of a multilingual mixture.

Each language is a table of byte n-gram likelihoods, learned from labelled rows.  A
document is a mixture: each of its words comes from one language, and
expectation-maximisation estimates the proportions of the languages from the words'
likelihoods.  The language set starts with the language that is likeliest alone.  The
likelihood is concave in the proportions, so what all other languages together can add
is at most the largest of their slopes at the proportions found; where no slope exceeds
the penalty, half the logarithm of the number of words for each language, no larger set
can be better.  Otherwise the language of the largest slope joins and the proportions
are estimated anew; a set that does not pay its penalty ends the search.  Time grows
with the number of languages times one more than the document's own, and every labelled
language is learned.  The prediction is the set's largest language, the score its proportion.

Defined cases: text that is null or has no letter is ``und`` with score 0, as is
everything when no labelled row exists; ties go to the first language in code point order;
rows equal in lang, doc_id and text are learned from once;
a text of any length is read in steps; repeated rows each get the same result; an empty table gives an empty result;
columns other than doc_id, text and lang are ignored.

Tables of the DENSE languages with the most n-grams take half a megabyte each, all others
what their own n-grams need; both hold the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import STEP_BYTES, U64, Words, documents, fold, fresh, join_counted, mix, stored, text_steps

#: Distinct labelled rows of a language that are learned from, on average at most; chosen by a hash of doc_id and text.
TRAIN_DOCS = 400
#: Languages whose tables have a number for every cell.
DENSE = 64
#: Cells of the table that n-grams are hashed to, and their lengths in bytes.
CELLS, ORDERS = 1 << 16, (3, 4)
SMOOTHING = 0.5
STEPS = 10
UNKNOWN = "und"


def gram_cells(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each order, the cell of the n-gram that ends at each byte of a word; CELLS elsewhere.

    The bytes around a word count as one boundary mark; nothing is before the start of a document.
    """
    n = len(data)
    table = np.arange(256, dtype=np.uint64)
    table[[9, 10, 11, 12, 13, 32]] = 0
    y = table[data]
    inside = y > 0
    out = np.full((len(ORDERS), n), CELLS, np.int64)
    code = y.copy()
    for back in range(1, max(ORDERS)):
        before = np.zeros(n, U64)
        before[back:] = y[:-back]
        across = (starts[:, None] + np.arange(back)).ravel()
        before[across[across < n]] = 0
        code += before << U64(8 * back)
        if back + 1 in ORDERS:
            cell = (mix(code + U64(back)) % U64(CELLS)).astype(np.int64)
            out[ORDERS.index(back + 1), inside] = cell[inside]
    return out


def step_bytes(langs: int) -> int:
    """Bytes of text that are taken at once, fewer for more languages.

    Each has over a hundred bytes of arrays, and what the allocator once handed out stays with the worker.
    """
    return max(1, min(STEP_BYTES // 4, 8 * STEP_BYTES // max(1, langs)))


def cell_steps(data: np.ndarray, offsets: np.ndarray, step: int):
    """(lo, hi, cells) of steps of documents of any length; an n-gram may reach back into the step before."""
    back = max(ORDERS) - 1
    for lo in range(0, len(data), step):
        hi, start = min(len(data), lo + step), max(0, lo - back)
        starts = offsets[(offsets >= start) & (offsets < hi)] - start
        yield lo, hi, gram_cells(data[start:hi], starts)[:, lo - start :]


def word_logs(words: Words, offsets: np.ndarray, table: dict[str, np.ndarray]) -> np.ndarray:
    """Each word's log likelihood in each language."""
    dense, sparse = table["dense"], table["sparse"]
    k = len(dense) + len(sparse)
    out = np.zeros((len(words), k))
    for lo, hi, cells in cell_steps(words.data, offsets, step_bytes(k)):
        first, last = max(0, np.searchsorted(words.starts, lo, "right") - 1), np.searchsorted(words.starts, hi)
        if first < last:
            logs = sum(table["logs"][o][cells[o]] for o in range(len(ORDERS)))
            # a word may have begun in the step before; what lies between words is 0
            begin = np.maximum(words.starts[first:last], lo) - lo
            out[first:last, dense] += np.add.reduceat(logs, begin)
            if len(sparse):
                out[first:last, sparse] += sparse_logs(cells, begin, table)
    return out


def sparse_logs(cells: np.ndarray, begin: np.ndarray, table: dict[str, np.ndarray]) -> np.ndarray:
    """What the n-grams of the words that begin at some bytes add in the languages without a number for every cell."""
    k = len(table["sparse"])
    out = np.zeros((len(begin), k))
    for o in range(len(ORDERS)):
        at = np.flatnonzero(cells[o] < CELLS)
        word = np.searchsorted(begin, at, "right") - 1
        at, word = at[word >= 0], word[word >= 0]
        out += np.bincount(word, minlength=len(begin))[:, None] * table["unseen"][o]
        key = cells[o][at] + o * CELLS
        start, count = table["first"][key], table["first"][key + 1] - table["first"][key]
        entry = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        place = np.repeat(word, count) * k + table["lang"][entry]
        out += np.bincount(place, table["above"][entry], minlength=out.size).reshape(out.shape)
    return out


def lettered(words: Words) -> np.ndarray:
    """Whether each word has an ASCII letter or a byte beyond ASCII."""
    if not len(words):
        return np.zeros(0, bool)
    table = np.zeros(256, np.uint8)
    table[65:91] = table[97:123] = table[128:] = 1
    return np.maximum.reduceat(table[words.data], words.starts) > 0


def learn(docs: DataFrame, per_language: int = TRAIN_DOCS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and their log likelihoods.

    dense and sparse name the languages of either form.  logs: for each order CELLS + 1
    rows, the last of which is 0, of the dense ones; unseen: for each order what a cell
    without n-grams has in the sparse ones; first, lang, above: for each order and cell
    the stretch of languages that have it, and how much more they have.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    n = rows.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("rows")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "key"), 11).cast("double") / float(1 << 53)
    n = stored(n, "languages")
    sample = join_counted(rows, n, ["lang"], "rows").where(draw * F.col("n") < per_language).dropDuplicates(["lang", "key"]).select("lang", "text")

    def entries(counted):
        for lang, have in counted.items():
            have = have[:, :CELLS]
            order, cell = np.nonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(order, pa.int32()), pa.array(cell, pa.int32()), pa.array(have[order, cell], pa.int64())], ["lang", "ord", "cell", "n"])

    def count(batches):
        counted: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, data, offsets in text_steps(batch.column(1), step_bytes(1)):
                words = Words(data, offsets, lower=True)
                for at, end, cells in cell_steps(words.data, offsets, step_bytes(1)):
                    for k in range(lo, hi):
                        a, b = max(at, offsets[k - lo]), min(end, offsets[k - lo + 1])
                        if a < b:
                            if langs[k] not in counted and len(counted) == DENSE:
                                yield from entries(counted)
                                counted = {}
                            have = counted.setdefault(langs[k], np.zeros((len(ORDERS), CELLS + 1), np.int64))
                            for o in range(len(ORDERS)):
                                np.add.at(have[o], cells[o, a - at : b - at], 1)
        yield from entries(counted)

    counts = sample.mapInArrow(count, "lang string, ord int, cell int, n long").groupBy("lang", "ord", "cell").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # of what the sample holds, at most CELLS rows for each language and each order
    names, order, cell, have = (found.column(c).combine_chunks() for c in ("lang", "ord", "cell", "n"))
    langs = sorted(set(names.unique().to_pylist()))
    lang = pc.index_in(names, pa.array(langs, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    return langs, tabled(lang, order.to_numpy(), cell.to_numpy(), have.to_numpy(), len(langs))


def tabled(lang: np.ndarray, order: np.ndarray, cell: np.ndarray, count: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The tables of k languages from the counts of their n-grams."""
    total = np.array([np.bincount(lang[order == o], count[order == o], minlength=k) for o in range(len(ORDERS))]).reshape(len(ORDERS), k)
    used = np.array([max(1, len(np.unique(cell[order == o]))) for o in range(len(ORDERS))])
    below = np.log(total + SMOOTHING * (used[:, None] + 1))
    # the orders overlap, so each counts for its share only
    unseen = (np.log(SMOOTHING) - below) / len(ORDERS)
    seen = (np.log(count + SMOOTHING) - below[order, lang]) / len(ORDERS)
    by_size = np.argsort(-np.bincount(lang, minlength=k), kind="stable")
    dense, sparse = np.sort(by_size[:DENSE]), np.sort(by_size[DENSE:])
    place = np.zeros(k, np.int64)
    place[dense], place[sparse] = np.arange(len(dense)), np.arange(len(sparse))
    full = np.isin(lang, dense)
    logs = np.zeros((len(ORDERS), CELLS + 1, len(dense)), np.float32)
    logs[:, :CELLS] = unseen[:, None, dense]
    logs[order[full], cell[full], place[lang[full]]] = seen[full]
    rest = np.flatnonzero(~full)
    rest = rest[np.lexsort((lang[rest], cell[rest], order[rest]))]
    first = np.searchsorted(order[rest].astype(np.int64) * CELLS + cell[rest], np.arange(len(ORDERS) * CELLS + 1))
    above = (seen[rest] - unseen[order[rest], lang[rest]]).astype(np.float32)
    return {"dense": dense, "sparse": sparse, "logs": logs, "unseen": unseen[:, sparse], "first": first, "lang": place[lang[rest]].astype(np.int32), "above": above}


def proportions(likelihood: np.ndarray, first: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen language set's proportions of each document, 0 for the others, and its penalised likelihood.

    likelihood: words by languages, each row scaled to a maximum of 1; first: word
    offsets of the documents, none of which is empty; shift: logarithms of the scales.
    """
    least = 1e-300
    docs = np.arange(len(first) - 1)
    best = np.zeros((len(docs), likelihood.shape[1]))
    alone = np.add.reduceat(np.log(np.maximum(likelihood, least)), first[:-1])
    chosen = alone.argmax(axis=1)[:, None]
    best[docs, chosen[:, 0]] = 1
    best_value = alone.max(axis=1) + np.add.reduceat(shift, first[:-1])
    share, size = np.ones((len(docs), 1)), np.diff(first)
    while chosen.shape[1] < likelihood.shape[1]:
        starts, of = np.cumsum(size) - size, np.repeat(np.arange(len(docs)), size)
        mixed = (np.take_along_axis(likelihood, chosen[of], 1) * share[of]).sum(axis=1)
        slope = np.add.reduceat(likelihood / np.maximum(mixed, least)[:, None], starts) - size[:, None]
        np.put_along_axis(slope, chosen, -np.inf, 1)
        penalty = 0.5 * np.log(size + 1)
        joins = slope.max(axis=1) > penalty
        if not joins.any():
            break
        # documents whose set may grow, and their words
        kept = joins[of]
        likelihood, shift = likelihood[kept], shift[kept]
        docs, size, penalty = docs[joins], size[joins], penalty[joins]
        chosen = np.hstack([chosen[joins], slope[joins].argmax(axis=1)[:, None]])
        width = chosen.shape[1]
        share = np.hstack([share[joins] * (width - 1) / width, np.full((len(docs), 1), 1 / width)])
        starts, of = np.cumsum(size) - size, np.repeat(np.arange(len(docs)), size)
        own = np.take_along_axis(likelihood, chosen[of], 1)
        for _ in range(STEPS):
            joint = own * share[of]
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), least)
            share = np.add.reduceat(joint, starts) / size[:, None]
        value = np.add.reduceat(np.log(np.maximum((own * share[of]).sum(axis=1), least)) + shift, starts) - (width - 1) * penalty
        better = value > best_value[docs]
        best_value[docs[better]] = value[better]
        best[docs[better]] = 0
        best[docs[better][:, None], chosen[better]] = share[better]
        if not better.any():
            break
        kept = better[of]
        likelihood, shift = likelihood[kept], shift[kept]
        docs, size, chosen, share = docs[better], size[better], chosen[better], share[better]
    return best, best_value


def predict(docs: DataFrame, langs: list[str], table: dict[str, np.ndarray], added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs that are given, with the prediction and its score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)  # at most half a megabyte for each language, by its n-grams in the sample
    names = docs.columns
    d = docs.select("*", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(fresh(docs, "_letter")))
    at, schema = names.index("text"), T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])

    def run(batches):
        table = shared.value
        for batch in batches:
            letter = batch.column(len(names)).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_steps(batch.column(at), step_bytes(len(langs))):
                words = Words(data, offsets, lower=True)
                pred = np.full(hi - lo, UNKNOWN, object)
                score = np.zeros(hi - lo)
                keep = np.flatnonzero(lettered(words))
                if len(langs) and len(keep):
                    logs = word_logs(words, offsets, table)[keep]
                    first = np.searchsorted(keep, words.first)
                    full = np.flatnonzero(np.diff(first) > 0)
                    top = logs.max(axis=1)
                    best, _ = proportions(np.exp(logs - top[:, None]), np.append(first[full], len(keep)), top)
                    pred[full] = np.array(langs, object)[best.argmax(axis=1)]
                    score[full] = np.clip(best.max(axis=1), 0, 1)
                none = ~letter[lo:hi]
                pred[none], score[none] = UNKNOWN, 0
                columns = [batch.column(k).slice(lo, hi - lo) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score)], [*names, *added])

    return d.mapInArrow(run, schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    langs, table = learn(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), langs, table).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
