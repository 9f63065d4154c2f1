"""Subword lattice language model: the marginal probability of a text over all segmentations.

The lattice of a word has an edge for each piece of an existing vocabulary, one for the bytes of a character the vocabulary
lacks, and two for the whole word, if the training texts have it: one weighted by its count in the text's language, one by
its count in all languages. Piece scores are learned for each language from the training words, each distinct word counted once,
since pieces have to carry the words that were not seen. A forward recursion in log space sums over all paths. Words are separated
by white space and no piece crosses it, so a text's probability is the product of its words' and an end's, and
each distinct word is worked out once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, columns_of, parallelism, staged

END = " "  # stands for the end token; no word has a space
DISCOUNT = 0.75  # taken from each seen word's count, for the level below
HEAD = 300_000  # most frequent words sent to every task; the bound of the broadcast
HEAD_BYTES = 64  # longer words are never among them
FLUSH = 400_000  # distinct words a counting task holds
BLOCK = 100_000  # words of one language valued together
PIECE_PRIOR = 1000.0  # weight of the shared piece scores in a language's own


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def text_of(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def counted(docs: DataFrame) -> DataFrame:
    """(word, lang, n_all, n_train, c): counts over all whole texts; c is the training count in all languages.

    Tasks add up their own words before the shuffle, so a word that every text has is one row a task. One exchange, on the word.
    """

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, Counter] = {}

        def rows():
            for (lang, held), c in sums.items():
                words, n = [text_of(w) for w in c], np.fromiter(c.values(), np.int64, len(c))
                for at in range(0, len(words), 50_000):
                    part = n[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.string()), pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(part * (not held))], ["word", "lang", "n_all", "n_train"])
            sums.clear()

        for doc_ids, langs, texts in batches(it, "doc_id", "lang", "text"):
            for doc_id, lang, text in zip(doc_ids, langs, texts):
                c = sums.setdefault((lang or "", is_held_out(doc_id)), Counter())
                c.update(tokens(text))
                c[END.encode()] += 1
                if sum(map(len, sums.values())) > FLUSH:
                    yield from rows()
        yield from rows()

    parts = docs.select("doc_id", "lang", "text").mapInArrow(scan, "word string, lang string, n_all long, n_train long")
    each = parts.repartition(parallelism(docs.sparkSession), "word").groupBy("word", "lang").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))
    every = each.groupBy("word").agg(F.sum("n_train").alias("c"), F.collect_list(F.struct("lang", "n_all", "n_train")).alias("of"))
    return staged(every.select("word", "c", F.explode("of").alias("o")).select("word", "o.lang", "o.n_all", "o.n_train", "c"))


def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def piece_counts(words: DataFrame, model: str) -> DataFrame:
    """(lang, piece, k): pieces in the vocabulary's own segmentation of each distinct training word, counted once."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, sums = processor(model), {}
        for names, langs in batches(it, "word", "lang"):
            by: dict[str, list[str]] = {}
            for w, lang in zip(names, langs):
                by.setdefault(lang, []).append(w)
            for lang, some in by.items():
                total = sums.setdefault(lang, np.zeros(sp.get_piece_size(), np.int64))
                for at in range(0, len(some), 10_000):
                    ids = [i for one in sp.encode(some[at : at + 10_000], num_threads=1) for i in one]
                    total += np.bincount(np.array(ids, np.int64), minlength=len(total))
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "piece", "k"])

    rows = words.where((F.col("n_train") > 0) & (F.col("word") != END)).select("word", "lang")
    return rows.mapInArrow(scan, "lang string, piece long, k long").groupBy("lang", "piece").agg(F.sum("k").alias("k"))


class Lattice:
    """Log probability of a word over all segmentations into pieces with log probabilities ``scores``."""

    def __init__(self, pieces: list[str], kinds: list[int]):
        self.index = {p: i for i, (p, kind) in enumerate(zip(pieces, kinds)) if kind == 0}
        self.bytes = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(pieces, kinds)) if kind == 1}
        self.longest = max((len(p) for p in self.index), default=1)

    def log_probability(self, word: str, scores: list[float]) -> float:
        s, get, longest, exp, log = "▁" + word, self.index.get, self.longest, math.exp, math.log
        forward = [0.0]
        for end in range(1, len(s) + 1):
            terms = []
            for start in range(max(0, end - longest), end):
                i = get(s[start:end])
                if i is not None:
                    terms.append(forward[start] + scores[i])
            if get(s[end - 1]) is None:
                terms.append(forward[end - 1] + sum(scores[self.bytes[b]] for b in s[end - 1].encode("utf-8", "surrogatepass")))
            top = max(terms)
            forward.append(top + log(sum(exp(t - top) for t in terms)) if len(terms) > 1 else top)
        return forward[-1]


def vocabulary_of(model: str) -> tuple[list[str], list[int], int]:
    """(pieces, kinds, end id): kind 0 is a piece of text, 1 a byte, 2 a control symbol."""
    sp = processor(model)
    ids = range(sp.get_piece_size())
    kinds = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in ids]
    return [sp.id_to_piece(i) for i in ids], kinds, sp.eos_id()


def valued(words: DataFrame, model: str, n: int, v: int) -> DataFrame:
    """Adds to every word of each language: base (log10), score (log10 of the lattice), known.

    Every language has piece scores of its own, its counts beside the shared scores as a prior. They meet the language's words by a
    join on (language, block of words), so their number has no bound and a hot language is many tasks. Only the shared
    counts, one for each piece of the vocabulary, reach the driver.
    """
    pieces, kinds, end = vocabulary_of(model)
    counts = staged(piece_counts(words, model))
    shared = np.full(len(pieces), 0.01)
    for r in counts.groupBy("piece").agg(F.sum("k").alias("k")).collect():
        shared[r.piece] += r.k
    common = words.sparkSession.sparkContext.broadcast((pieces, kinds, shared / shared.sum()))
    langs = staged(words.groupBy("lang").agg(
        F.sum("n_train").alias("t"), F.sum((F.col("n_train") > 0).cast("long")).alias("types"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    # A language's totals are two more rows, of pieces -1 and -2.
    facts = counts.unionByName(langs.select("lang", F.lit(-1).cast("long").alias("piece"), F.col("t").alias("k"))).unionByName(langs.select("lang", F.lit(-2).cast("long").alias("piece"), F.col("types").alias("k")))
    right = facts.join(langs.select("lang", "blocks"), "lang").select("lang", "piece", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    left = words.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks"))).drop("blocks")
    fields = pa.schema([("word", pa.string()), ("lang", pa.string()), ("n_all", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    built: list[Lattice] = []  # once a task

    def values(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces, kinds, shared = common.value
        if not left.num_rows:
            return fields.empty_table()
        if not built:
            built.append(Lattice(pieces, kinds))
        at, k = right["piece"].to_numpy(), right["k"].to_numpy()
        t, types = int(k[at == -1].sum()), int(k[at == -2].sum())
        own = PIECE_PRIOR * shared
        own[at[at >= 0]] += k[at >= 0]
        s = np.log(own / own.sum()).tolist()
        score = []
        for w, kt, kk in zip(*(left[c].to_pylist() for c in ("word", "n_train", "c"))):
            below = s[end] if w == END else built[0].log_probability(w, s)
            p = math.exp(below) if below > -700 else 0.0
            if n:
                p = (max(kk - DISCOUNT, 0) + DISCOUNT * v * p) / n
                below += math.log(DISCOUNT * v / n)
            if t:
                p = (max(kt - DISCOUNT, 0) + DISCOUNT * types * p) / t
                below += math.log(DISCOUNT * types / t)
            score.append(math.log10(p) if p > 1e-290 else below / math.log(10))
        c = left["c"].to_numpy()
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        return pa.Table.from_arrays([left["word"], left["lang"], left["n_all"], pa.array((c > 0).astype(np.int64)), pa.array(base), pa.array(score, pa.float64())], schema=fields)

    pairs = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block"))
    return staged(pairs.applyInArrow(values, "word string, lang string, n_all long, known long, base double, score double"))


def head_floor(values: DataFrame) -> int:
    """Least count such that at most HEAD words reach it, from the number of words by the leading bits of their count."""
    low = "greatest(length(bin(n_all)) - 6, 0)"
    steps = values.where(F.octet_length("word") <= HEAD_BYTES).groupBy(F.expr(f"shiftleft(shiftright(n_all, {low}), {low})").alias("n")).count().collect()
    floor, have = None, 0
    for r in sorted(steps, key=lambda r: -r.n):
        if have + r["count"] > HEAD:
            break
        floor, have = r.n, have + r["count"]
    return floor if floor is not None else 1 << 62


def scored(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id as text) mod 10 is not 0, and from those without an id. A null text is empty, a
    null language is one of its own. Repeated rows are scored each. The at most HEAD most frequent words, whose number and
    length are bounded, are sent to all tasks; the others are joined. An empty table gives none.
    """
    spark = docs.sparkSession
    docs = columns_of(docs, doc_id=id_col, text=text_col, lang=lang_col)
    words = counted(docs)
    n = words.agg(F.sum("n_train")).first()[0] or 0
    v = words.where("c > 0").select("word").distinct().count()
    values = valued(words, model, n, v)
    floor = head_floor(values)
    is_head = (F.col("n_all") >= floor) & (F.octet_length("word") <= HEAD_BYTES)
    head = spark.sparkContext.broadcast([tuple(c) for c in values.where(is_head).select("word", "lang", "known", "base", "score").toArrow().to_pydict().values()])
    fields = [("row", pa.int64()), ("word", pa.string()), ("lang", pa.string()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    cache: dict = {}

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        names, langs, known, base, score = head.value
        index: dict[str, dict[bytes, int]] = {}
        for i, (w, lang) in enumerate(zip(names, langs)):
            index.setdefault(lang, {})[w.encode()] = i
        known, base, score = np.array([*known, 0], np.int64), np.array([*base, 0.0]), np.array([*score, 0.0])
        for doc_ids, of, texts in batches(it, "doc_id", "lang", "text"):
            one: list[tuple] = []
            rows, rare, rare_of = [], [], []
            for doc_id, lang, text in zip(doc_ids, of, texts):
                lang, some = lang or "", [*tokens(text), END.encode()]
                get = index.get(lang, cache).get
                at = [get(w, -1) for w in some]
                if -1 in at:
                    new = [text_of(w) for w, i in zip(some, at) if i < 0]
                    rare += new
                    rare_of += [lang] * len(new)
                    rows += [row] * len(new)
                at = np.array(at)
                one.append((row, f"\t{row}", lang, doc_id, is_held_out(doc_id), len(some), int(known[at].sum()), float(base[at].sum()), float(score[at].sum())))
                row += 1
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*one), fields)], schema=pa.schema(fields))
            for a in range(0, len(rows), 100_000):
                b = slice(a, a + 100_000)
                k = len(rows[b])
                yield pa.RecordBatch.from_arrays([pa.array(x[b], t) for x, (_, t) in zip((rows, rare, rare_of), fields)] + [pa.nulls(k, t) for _, t in fields[3:]], schema=pa.schema(fields))

    kinds = "row long, word string, lang string, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    found = docs.select("doc_id", "lang", "text").mapInArrow(scan, kinds)
    tail = values.where(~is_head).select(F.col("word").alias("_w"), F.col("lang").alias("_l"), "known", "base", F.col("score").alias("_s"))
    # Rows of whole documents carry names of their own, which match nothing, so they are spread as evenly as words.
    joined = found.join(tail, (found.word == tail._w) & (found.lang == tail._l), "left")
    total = lambda a, b: F.sum(F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0)))
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        total("n_known", "known").alias("n_known"), total("base_score", "base").alias("base_score"), total("score", "_s").alias("score"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
