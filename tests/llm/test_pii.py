"""Base spans against Python's re, and terms that the corpus shows to reveal an entity."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bitgrove.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            if kind == "ip" and any(int(p) > 255 for p in v.split(".")):
                continue
            if kind == "card":
                if not 12 <= len(d) <= 19:
                    continue
                total = 0
                for i, c in enumerate(reversed(d)):
                    n = int(c) * (1 + i % 2)
                    total += n - 9 if n > 9 else n
                if total % 10:
                    continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            spans.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


CASES = [
    None, "", "plain words", "a@b.c", "a@b.c_d@e.f x@y@z.com a@@b.c a@b a@b.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3.4",
    "4539 1488 0343 6467 and 4539-1488-0343-6467, 45391488034364670 4111111111111111", "+1 (555) 010-9999 +49 30 1234567 +1 2 ++12 34 56 78 90-",
    "é日本 mail ä@example.com b.c@example.co.uk \U0001f600 10.0.0.1 \U0001f600\U0001f600 +1 234 567 8901", "9" * 5000, "a" * 20000, "1 " * 4000,
    " ".join("u%d@mail.example.com" % i for i in range(900)), "+1 222 333 4444 4111111111111111+1 222 333 4444", "a@b.c.d-e..f x.@-.- %@%.% 1.1.1.1@2.2.2.2",
]


def soup(seed):
    rng = random.Random(seed)
    return "".join(rng.choice("aZ0123456789019.@+-() _%é\n,") for _ in range(400))


def test_base_spans_match_brute_force(spark):
    texts = CASES + [soup(k) for k in range(150)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, _b string, start int, spans string")
    got = {r["doc_id"]: r["s"] for r in pii.find(docs).select("doc_id", pii.joined(F.col("base")).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_sf_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op5_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(x.startswith(kind) for x in want.split(","))
        assert not set(filter(None, want.split(","))) - set(r["spans"].split(","))


def test_terms_that_reveal_an_entity_are_found_everywhere(spark):
    rng = random.Random(5)
    filler = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "se", "ni", "po") for c in ("n", "l", "s")]
    words = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, words(40)) for i in range(300)]
    rows += [(300 + i, f"{words(10)} {rng.choice(filler)} Zanderkoop wrote from zk@mail.example.com {words(12)}") for i in range(6)]
    rows += [(400, f"{words(9)} zanderkoop {words(5)}"), (401, None), (402, "")]
    # exact and near copies of one passage are one testimony
    rows += [(500 + i, f"{'once' if i % 5 else 'twice' + 'abc'[i // 5 % 3]} quibbelwort q@mail.example.com seen {'again' if i % 7 else 'xyz'[i % 3] * 4}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(docs).select("doc_id", pii.joined(F.col("spans")).alias("spans")).collect()}
    text = dict(rows)[400]
    at = text.index("zanderkoop")
    assert found[400]["spans"] in (f"removed:{at}:{at + 10}", f"term:{at}:{at + 10}")
    assert all(not found[i]["spans"] for i in range(300))
    assert all("term" not in found[500 + i]["spans"] and "removed" not in found[500 + i]["spans"] for i in range(20))
    clean = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(docs).collect()}
    assert "zanderkoop" not in clean[400].lower() and "[EMAIL]" in clean[300] and clean[401] == "" and clean[5] == dict(rows)[5]


@pytest.mark.parametrize("lead, tail", [("", ""), ("best regards", ""), ("please contact", "words"), ("", "sent from home today")])
def test_terms_beside_an_entity_with_one_fixed_side_are_found(spark, lead, tail):
    rng = random.Random(6)
    filler = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "se", "ni", "po") for c in ("n", "l", "s")]
    words = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, words(40)) for i in range(300)]
    rows += [(300 + i, f"{words(20)} {lead} Janeth Doeman jd@mail.example.com {words(9) if tail == 'words' else tail}") for i in range(8)]
    rows += [(400, f"{words(9)} doeman {words(5)}")]
    spans = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined(F.col("spans")).alias("s"))
    at = rows[-1][1].index("doeman")
    assert spans.where("doc_id = 400").first()["s"] in (f"removed:{at}:{at + 6}", f"term:{at}:{at + 6}")


FILLER = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "ve", "pri") for b in ("ra", "se", "ni", "po", "gu") for c in ("n", "l", "s", "dan", "rim", "t")]


def terms_in(spark, rows):
    spans = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()
    text = dict(rows)
    place = lambda x: tuple(map(int, x.split(":")[1:]))
    return {text[r["doc_id"]][slice(*place(x))].lower() for r in spans for x in r["s"].split(",") if x.startswith(("term", "removed"))}


def test_a_term_far_from_the_entity_is_found_and_edited_copies_are_one_testimony(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice(FILLER) for _ in range(n)]
    rows = [(i, " ".join(words(60))) for i in range(400)]
    rows += [(1000 + i, " ".join([*words(20), "Farawaylu", *words(25), "fa@mail.example.com", *words(20)])) for i in range(6)]
    # eight texts made of one by other words in a tenth of the places, the entity's neighbours among them
    passage = [*words(30), "wibblefrost", *words(4), "wf@mail.example.com", *words(30)]
    for i in range(8):
        own = list(passage)
        for at in (*rng.sample(range(30), 3), 34, 36, *rng.sample(range(40, 66), 2)):
            own[at] = rng.choice(FILLER)
        rows.append((2000 + i, " ".join(own)))
    # entities in unlike texts of the common words: nothing but chance
    rows += [(3000 + 10 * e + i, " ".join([*words(30), f"chance{e}@mail.example.com", *words(30)])) for e in range(12) for i in range(4)]
    assert terms_in(spark, rows) == {"farawaylu"}


def test_terms_anywhere_in_a_text_and_beside_any_mention_are_found(spark):
    rng = random.Random(9)
    words = lambda n: [rng.choice(FILLER) for _ in range(n)]
    rows = [(i, " ".join(words(60))) for i in range(400)]
    rows += [(1000 + i, " ".join([*words(20), "fb@mail.example.com", *words(200), "Outerwindow", *words(30)])) for i in range(6)]
    rows += [(2000 + i, " ".join(["sc@mail.example.com", *words(150), "sc@mail.example.com", "Secondmention", *words(90)])) for i in range(6)]
    # one paragraph copied to the far ends of unlike texts is one testimony
    copied = [*words(50), "copiedfar", *words(50)]
    rows += [(3000 + i, " ".join([*words(20), "cp@mail.example.com", *words(200), *copied])) for i in range(6)]
    assert terms_in(spark, rows) == {"outerwindow", "secondmention"}


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_sums_before(spark, n):
    values = [(k * 7) % 11 for k in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>").select(pii.sums_before(F.col("v")).alias("s"))
    assert df.first()["s"] == [sum(values[:k]) for k in range(n)]
