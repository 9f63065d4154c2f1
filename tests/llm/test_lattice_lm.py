import math
import re
import zlib
from collections import Counter

import pytest

from marketloom.llm import catalog, lattice_lm


def paths(s, pieces, byte):
    """All segmentations, by recursion."""
    if not s:
        return [0.0]
    out = []
    for n in range(1, len(s) + 1):
        if s[:n] in pieces:
            out += [pieces[s[:n]] + rest for rest in paths(s[n:], pieces, byte)]
    if s[0] not in pieces:
        out += [sum(byte[b] for b in s[0].encode()) + rest for rest in paths(s[1:], pieces, byte)]
    return out


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab"] + [f"<0x{b:02X}>" for b in range(256)]
    kinds = [0] * 8 + [1] * 256
    scores = [-1.0 - 0.1 * i for i in range(8)] + [-6.0] * 256
    lattice = lattice_lm.Lattice(pieces, kinds)
    for word in ("a", "abab", "ababab", "é", "aéb", "aéé"):
        every = paths("▁" + word, dict(zip(pieces[:8], scores)), [-6.0] * 256)
        assert lattice.log_probability(word, scores) == pytest.approx(math.log(sum(map(math.exp, every))))
    assert math.isfinite(lattice.log_probability("ab" * 20000, scores))


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


@pytest.mark.parametrize("head", [300_000, 50, 0])
def test_base_counts_and_scores(spark, odd_docs, monkeypatch, head):
    monkeypatch.setattr(lattice_lm, "HEAD", head)
    monkeypatch.setattr(lattice_lm, "FLUSH", 200)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("doc_id >= 20").unionByName(odd_docs.select("doc_id", "text", "lang"))
    rows = docs.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = tokens(r.text)
        want.append((r.doc_id or -1, held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)))
    got = lattice_lm.scored(docs, catalog.vocabulary("piece_bpe_32k.model")).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=key) == sorted(want, key=key)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    test_base_counts_and_scores.scores = getattr(test_base_counts_and_scores, "scores", None) or sorted((r.doc_id or -1, round(r.score, 6)) for r in got)
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in got) == test_base_counts_and_scores.scores  # wherever words are looked up


def test_held_out_likelihood_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    rows = lattice_lm.scored(docs, catalog.vocabulary("piece_bpe_32k.model")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_one_distribution(spark):
    """Words' probabilities are a part of one: those of all seen words and the end sum to less than one."""
    docs = spark.createDataFrame([(i, "a b c d a b c e f g " * 3, "en") for i in range(1, 60)], "doc_id long, text string, lang string")
    words = lattice_lm.counted(docs)
    n = words.agg({"n_train": "sum"}).first()[0]
    v = words.where("c > 0").count()
    total = sum(10**r.score for r in lattice_lm.valued(words, catalog.vocabulary("piece_bpe_32k.model"), n, v).collect())
    assert 0.8 < total <= 1


def whole_formula(rows, model):
    """Scores by plain Python, from the docstring: every language has piece scores of its own, however many there are."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    size, ids = sp.get_piece_size(), range(sp.get_piece_size())
    plain = {sp.id_to_piece(i): i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
    train = [(lang or "", w) for d, text, lang in rows if zlib.crc32(str(d).encode()) % 10 for w in tokens(text)]
    own, every = Counter(train), Counter(w for _, w in train)
    k = {}
    for lang, w in own:
        if w is not None:
            k.setdefault(lang, Counter()).update(sp.encode(w))
    total = {i: 0.01 + sum(c[i] for c in k.values()) for i in ids}
    whole = sum(total.values())
    shared = {i: x / whole for i, x in total.items()}
    n, v = len(train), len(every)

    def score(lang, w):
        c = k.get(lang, Counter())
        below = 1000.0 + sum(c.values())
        p = {i: (1000.0 * shared[i] + c[i]) / below for i in ids} if (lang, None) not in cache else cache[lang, None]
        cache[lang, None] = p
        if w is None:
            q = p[sp.eos_id()]
        else:
            s = "▁" + w
            f = [1.0] + [0.0] * len(s)
            for b in range(1, len(s) + 1):
                f[b] = sum(f[a] * p[plain[s[a:b]]] for a in range(b) if s[a:b] in plain)
                if s[b - 1] not in plain:
                    f[b] += f[b - 1] * math.prod(p[byte[x]] for x in s[b - 1].encode())
            q = f[-1]
        q = (max(every[w] - 0.75, 0) + 0.75 * v * q) / n
        t, types = sum(x for (g, _), x in own.items() if g == lang), len([1 for g, _ in own if g == lang])
        return math.log10((max(own[lang, w] - 0.75, 0) + 0.75 * types * q) / t if t else q)

    cache, words = {}, {}
    for _, text, lang in rows:
        for w in tokens(text):
            if (lang or "", w) not in words:
                words[lang or "", w] = score(lang or "", w)
    assert size == len(plain) + len(byte) + sum(1 for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    return {d: sum(words[lang or "", w] for w in tokens(text)) for d, text, lang in rows}


@pytest.mark.parametrize("block", [100_000, 3])
def test_seventy_languages_have_scores_of_their_own(spark, monkeypatch, block):
    """The smallest language scores as the largest does; the last one has held-out documents only; blocks of words change nothing."""
    monkeypatch.setattr(lattice_lm, "BLOCK", block)
    rows = [(i, f"alpha beta{i % 7} été {'gamma ' * (i % 5)}delta{i}", f"l{i % 70}" if i % 70 else None) for i in range(1, 200)]
    rows += [(i, "zeta alpha Beta1 ünseen", "none") for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0]
    model = catalog.vocabulary("piece_bpe_32k.model")
    got = {r.doc_id: r.score for r in lattice_lm.scored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    want = whole_formula(rows, model)
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-9) for d in want)


def test_empty_table(no_docs):
    assert lattice_lm.scored(no_docs, catalog.vocabulary("piece_bpe_32k.model")).count() == 0
