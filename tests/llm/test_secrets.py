"""Base spans against plain regular expressions on whole texts; the battery against planted strings and ordinary ones."""

import hashlib
import random
import re

from marketloom.llm import secrets as S

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(S.KINDS[k], a, b) for a, k, b in sorted(found)]


def texts(rng):
    parts = ["Token = \"abc123\"", "paſſword: x1y2z3", "api_key:token=abcdef", "token=token :abcdef", "PASSWD='" + "A" * 9 + "'", "secret :  short", "AKIA" + "Q7" * 9, "AKIA12", "AKIAAKIA" + "Z9" * 9,
             "deadbeef" * 3, "deadbeef" * 2, "é", "日本", "\n", "é0123456789abcdef01234567é", "token\t=abcdef", "apikey=" + "f0" * 20, "toKen=abcdefg"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "é", "x"]) for _ in range(rng.randint(0, 8))) for _ in range(300)]


def test_base_spans_by_brute_force(spark, odd_docs, no_docs):
    made = list(enumerate(texts(random.Random(1)), 100))
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    want = []
    for doc_id, text in docs.collect():
        spans = brute(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((doc_id, *(sum(k == kind for k, _, _ in spans) for kind in S.KINDS[:3]), hashlib.sha256(line.encode()).hexdigest()))
    got = S.digest(S.scan(docs)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    by_id = {r.doc_id: r.spans for r in got}
    for doc_id, text in made:
        left = [s for s in by_id[doc_id].split(",") if s and not s.startswith("random")]
        assert left == [f"{k}:{a}:{b}" for k, a, b in brute(text)]
    assert S.scan(no_docs).count() == 0 and S.scan(odd_docs).count() == odd_docs.count()


def words(rng, n):
    """Ordinary text by letter frequency, with long words, names of parts and numbers in it."""
    letters = "etaoinshrdlucmfwypvbgkjxqz"
    weights = [1 / (k + 2) for k in range(26)]
    one = lambda a, b: "".join(rng.choices(letters, weights, k=rng.randint(a, b)))
    out = []
    for _ in range(n):
        kind = rng.random()
        out.append(one(1, 9) if kind < 0.9 else one(16, 40) if kind < 0.94 else "_".join(one(3, 9) for _ in range(5)) if kind < 0.97 else one(4, 9).title() * 4 if kind < 0.98 else str(rng.randint(10**15, 10**30)))
    return out


def test_planted_random_strings_are_found_and_ordinary_ones_left(spark):
    rng = random.Random(9)
    alphabets = {n: a for n, a in S.ENCODINGS.items() if n in ("base62", "base64", "base36", "HEX", "base64url")}
    rows, planted = [], {}
    for k in range(600):
        w = words(rng, 120)
        if k % 3 == 0:
            secret = "".join(rng.choices(alphabets[rng.choice(list(alphabets))], k=rng.choice([48, 64, 88])))
            at = rng.randint(0, 119)
            planted[k] = sum(len(x) + 1 for x in w[:at]), len(secret)
            w.insert(at, secret)
        rows.append((k, " ".join(w)))
    found = {r.doc_id: [(s.start, s.end - s.start) for s in r.random] for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(p in found[k] for k, p in planted.items())
    other = sum(len(v) for v in found.values()) - hits
    share = {n: sum(p in found[k] for k, p in planted.items() if p[1] == n) / sum(p[1] == n for p in planted.values()) for n in (48, 64, 88)}
    assert share[48] >= 0.75 and share[64] >= 0.9 and share[88] >= 0.95, share  # the rate is held by giving up short ones
    assert other <= 0.05 * hits, (other, hits)


def test_encodings_and_tests():
    assert S.encoding_of(b"0123456789abcdef00") == "hex" and S.encoding_of(b"1234567890123456") is None and S.encoding_of(b"ordinaryletters") is None
    assert S.encoding_of(b"ABCDEFG234567ABC") == "base32" and S.encoding_of(b"a-b_c-d1e2f3g4h5Z") == "base64url" and S.encoding_of(b"a+b_") is None
    assert S.battery(b"0123456789abcdef" * 4, "hex")[1] < 0.01  # counts are even, the order is not
    assert S.battery(b"0" * 40 + b"a", "hex")[1] < 1e-6
