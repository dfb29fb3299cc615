import re

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import identity, text, times


def evaluate(spark, make, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    cols = [F.col(f"c{k}") for k in range(len(rows[0]))]
    return [r["x"] for r in df.select("i", make(*cols).alias("x")).orderBy("i").collect()]


def test_normalized_name(spark):
    names = ["ACME Corp", "acme  corp.", "Straße ẞ", "ﬁne ﬂow", "ŉ x", "", None, "—", "İstanbul K", "a_b"]
    expected = [" ".join(re.sub("[^0-9a-z]+", " ", (n or "").casefold()).split()) for n in names]
    assert evaluate(spark, text.normalized_name, [(n,) for n in names]) == expected


def plain_sentences(s):
    """The rule, character by character: dot runs of two or more are a space; a run of closing marks, white space and then a
    capital or digit (perhaps behind one opening mark) part sentences, unless an abbreviation or initial is before the run."""
    chars = []
    for c in s:  # runs of dots become one space
        if c == "." and chars and chars[-1] in (".", "..."):
            chars[-1] = "..."
        else:
            chars.append(c)
    chars = [" " if c == "..." else c for c in chars]
    starts = lambda c: c.isascii() and (c.isupper() or c.isdigit()) or c in "ÄÖÜ"
    parts, word, state = [""], "", "text"
    for at, c in enumerate(chars):
        if state == "text" and c in ".!?":
            state, before = "closed", word.lower()
        elif state in ("closed", "gap") and c.isspace():
            state = "gap"
        elif state == "closed" and c not in ".!?":
            state = "text"
        elif state == "gap":
            ahead = chars[at + 1] if at + 1 < len(chars) else ""
            opens = starts(c) or (c in "\"'([" and ahead and starts(ahead))
            if opens and before not in text.ABBREVIATIONS and not (len(before) == 1 and before.isalpha()):
                parts.append("")
            state = "closed" if c in ".!?" else "text"
            before = ""
        parts[-1] += c
        word = word + c if c == "." or c.isascii() and c.isalpha() else ""
    return [p.strip() for p in parts if p.strip()]


CASES = [
    "One. Two", "Version 1.2.3 works. It does", "Dr. No came. He left", "See e.g. The case", "J. Smith", "Wait... What? Yes! 3 more", "a.b. C", "etc.! The end", "No split. lower",
    "U.S. Army", "x. Y", "He said \"Hi. There\" (Yes). 'Ok'", "Ende. Über", "Ende. Älter", "", "  ", "approx. 5. Next", "Fig. 3 shows. Vol. 2", "A.M. Then", "foo?! Bar", "min. Max. sec. X", "No. No. No", "www.a.de. Hier",
]


def test_sentences(spark, sf_dir):
    assert evaluate(spark, text.sentences, [(c,) for c in CASES]) == [plain_sentences(c) for c in CASES]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", text.sentences(F.col("text")).alias("s")).collect()
    assert all(r["s"] == plain_sentences(r["text"]) for r in docs)


def test_word_overlap(spark):
    pairs = [("uses MongoDB.", "uses MongoDB now."), ("uses DuckDB", "uses MongoDB"), ("", ""), ("", "a"), ("Über über", "ÜBER"), (None, "")]
    w = lambda s: set(re.findall(r"\w+", (s or "").lower()))
    expected = [len(w(a) & w(b)) / len(w(a) | w(b)) if w(a) | w(b) else 1.0 for a, b in pairs]
    assert evaluate(spark, text.word_overlap, pairs) == pytest.approx(expected)


def test_secret_shapes(spark):
    made = {
        "api key": "gh" + "p_" + "a1B2" * 9, "private key": "-----BEGIN " + "RSA PRIVATE KEY-----", "jwt": "ey" + "J" + "a" * 16 + "." + "b" * 16 + "." + "c" * 12,
        "bot token": "12345678" + ":" + "A" * 35, "credential assignment": "pass" + "word: hunter2hunter2", "iban": "DE" + "12 1234 1234 1234 1234 12",
    }
    for family, sample in made.items():
        assert evaluate(spark, text.secret_shapes, [(f"see {sample} here",)]) == [[family]]
    clean = ["commit 0123456789abcdef0123456789abcdef01234567", "0x52908400098527886E0F7030069857D2E4169EE7", "a@b.example", None]
    assert evaluate(spark, text.secret_shapes, [(c,) for c in clean]) == [[]] * 4
    assert evaluate(spark, text.secret_shapes, [("password:", "hunter2hunter2")]) == [["credential assignment"]]  # over two fields


def test_query_cleanup(spark):
    assert evaluate(spark, text.clean_query, [("a _ b",), ("_",), ("snake_case _",), (" ",)]) == ["a b", None, "snake_case", None]


def test_keys(spark):
    import hashlib
    import uuid

    rows = [("en", " name ", "body\n", ""), ("en", "n", "b", "2024-01-01")]
    expected = [hashlib.sha256("\x1f".join([d, n.strip(), b.strip(), v]).encode()).hexdigest()[:32] for d, n, b, v in rows]
    assert evaluate(spark, identity.record_key, rows) == expected
    assert evaluate(spark, lambda *c: identity.uuid_of(identity.record_key(*c)), rows) == [str(uuid.UUID(hex=k)) for k in expected]


def test_content_digest_ignores_null_keeps_empty(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("p1", "t", "", None, ["a", "ü"], "pending")], "id string, text string, supersedes string, link string, facts array<string>, status string")
    got = df.select(identity.content_digest(df.columns).alias("d")).first()["d"]
    content = {"id": "p1", "text": "t", "supersedes": "", "facts": ["a", "ü"]}
    assert got == "sha256:" + hashlib.sha256(json.dumps(content, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_instants(spark):
    got = evaluate(spark, lambda c: times.iso(times.instant(c)), [("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+02:00",), ("2024-01-02 03:04:05",), ("nonsense",), ("",)])
    assert got == ["2024-01-02T03:04:05+00:00", "2024-01-02T01:04:05+00:00", "2024-01-02T03:04:05+00:00", None, None]


def test_retry_delay(spark):
    got = evaluate(spark, lambda c: identity.retry_delay(c, F.lit(3), 1.0), [("ffffffff" + "0" * 24,), ("0" * 32,)])
    assert got == pytest.approx([4.25, 4.0])
