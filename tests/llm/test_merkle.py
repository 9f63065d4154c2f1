import hashlib
import random

from pyspark.sql import functions as F

from marketloom.llm import merkle

HASH = lambda s: hashlib.sha256(s.encode()).hexdigest()


def expected_edits(rows):
    """The next document in descending id order, by brute force; texts with one id are equal here, so ties do not matter."""
    rows = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "") for r in rows), key=lambda x: -x[0])
    out = []
    for i, (d, t) in enumerate(rows):
        nxt, h = rows[(i + 1) % len(rows)][1], len(t) // 2
        out.append((d, len(t), HASH(t[: len(t) - h] + nxt[:h])))
    return sorted(out)


def test_edits_follow_the_next_document(odd_docs, no_docs):
    got = merkle.compared(odd_docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_chars, r.edited_sha256) for r in got) == expected_edits(odd_docs.collect())
    assert merkle.compared(no_docs).count() == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_equal_texts_and_only_they_share_a_fingerprint(spark):
    base = "First one. Second one.\nThird line here.\n\nNew section, with more. " * 9
    texts = [base, base, base.replace("Third", "THIRD", 1), base + " ", base[::-1], "", None, "x", "a\nb", "b\na", "aa. aa. ", "aa. "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in merkle.compared(df).collect()}
    assert got[0] == got[1] and got[5] == got[6]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == ((a or "") == (b or ""))


def test_one_edit_changes_one_section(spark):
    lines = [f"Paragraph {i} says something of its own.\n" for i in range(200)]
    edited = lines.copy()
    edited[77] = "Paragraph 77 was rewritten.\n"
    df = spark.createDataFrame([("".join(lines), "".join(edited))], "a string, b string")
    a, b = merkle.tree(F.col("a")), merkle.tree(F.col("b"))
    r = df.select(merkle.likeness(a, b).alias("near"), merkle.differing(a, b).alias("diff"), F.size(a["parts"]).alias("n")).first()
    assert 0.97 < r.near < 1 and r.n > 5
    assert 1 <= len(r["diff"]) <= 2 and sum(len(d.pieces) for d in r["diff"]) == 1


def test_no_python_and_one_text_exchange(spark):
    plan = merkle.compared(spark.range(5).selectExpr("id as doc_id", "cast(id as string) as text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1


def test_texts_without_marks_have_bounded_leaves(spark):
    rng = random.Random(4)
    texts = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000)), " ".join(f"w{rng.randrange(10**5)}" for _ in range(500)), "a" * 3000, "😀é" * 700, "x" * 129]
    df = spark.createDataFrame([(i, t, t[: len(t) // 2] + "".join(reversed(texts[1 - i] if i < 2 else t))[: len(t) // 2]) for i, t in enumerate(texts)], "i int, a string, b string")
    a, b = merkle.tree(F.col("a")), merkle.tree(F.col("b"))
    pieces = F.flatten(F.transform(F.split("a", merkle.CUT), merkle.bounded))
    for r in df.select("i", "a", pieces.alias("p"), merkle.likeness(a, b).alias("near")).collect():
        assert "".join(r.p) == r.a and max(map(len, r.p)) <= merkle.LONG and len(r.p) <= len(r.a) / 8
        assert r.i > 1 or 0.3 < r.near < 0.7


def test_each_text_is_hashed_once(spark):
    """The next document's tree comes with its text, and the edited text's is made of the leaves of both."""
    plan = merkle.compared(spark.range(5).selectExpr("id as doc_id", "cast(id as string) as text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text#") == 1
    assert "split(next_text#" not in plan and "split(concat(substring(text#" not in plan and "split(edited#" not in plan


def test_edited_trees_equal_trees_made_anew(spark):
    """Cuts at, before and behind the seam, by marks, line feeds and window hashes, in texts of any length."""
    rng = random.Random(9)
    texts = ["", " ", "\n", ". ", " .", "x.", " y", "\n\n", "a" * 700, "😀é" * 400]
    texts += ["".join(rng.choices(". \nab,", k=rng.randrange(1, 12))) for _ in range(150)]
    texts += ["".join(rng.choices(". \n", [1, 1, 1], k=rng.randrange(5)) + rng.choices("abcdefgé😀 ", k=rng.randrange(90, 600)) + rng.choices(". \n", k=rng.randrange(5))) for _ in range(100)]
    rng.shuffle(texts)
    rows = []
    for i, t in enumerate(texts):
        h = len(t) // 2
        rows.append((i, t, t[: len(t) - h] + texts[i - 1][:h], texts[i - 1]))
    df = spark.createDataFrame(rows, "doc_id long, text string, edited string, next string")
    a, b, c = (merkle.tree(F.col(x)) for x in ("text", "edited", "next"))
    anew = df.select("doc_id", merkle.fingerprint(a), merkle.fingerprint(b), merkle.likeness(a, b), merkle.likeness(a, c))
    got = merkle.compared(df).select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, anew.collect()))
