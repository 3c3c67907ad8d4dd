"""BPE, licenses, HTML, toxicity, mixing and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bitgrove.llm import bpe, html_extract, license_scan, mixing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


# ---- BPE
def test_segment_tree_gives_the_library_s_ids(library):
    own = bpe.ByteBpe(bpe.tokenizer_source())
    rng = random.Random(1)
    odd = ["", "a" * 5000, "ab" * 3000, " " * 1000, "x<|endoftext|>y <|endoftext|>", "\x00\x1c \x1e\x1fa\x85b c​d　 e\xa0f", "it's I'M we'll 12½²x ٣٤", "é̃ñ 日本語 \U0001f600‍\U0001f469 \r\n\t\n  x", "<|endoftext", "�￿"]
    odd += ["".join(chr(rng.choice([*range(32, 127), 233, 0x4E00, 0x1F600])) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    odd += [" ".join("a" + chr(c) + chr(c) + " " + chr(c) + "1" for c in range(k, k + 97)) for k in (*range(0, 0xD700, 97), *range(0xE000, 0x20000, 97))]
    for s in odd:
        ids = np.frombuffer(own.encode(s), "<i4").tolist()
        want = library.encode(s, add_special_tokens=False).ids
        assert ids == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.ByteBpe(bpe.tokenizer_source())
    texts = [f"word{k} other{k}" for k in range(300)]
    first = [own.encode(t) for t in texts]
    assert [own.encode(t) for t in texts] == first and len(own.words) <= 50 and len(own.words.old) <= 50


def test_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = bpe.op7_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "hi " * 9000, "x")], "doc_id long, text string, ids string")
    made = bpe.encode(df, bpe.tokenizer_source(), with_decoded=True)
    assert sorted(len(r["ids"]) for r in made.collect())[:3] == [0, 0, 0] and made.count() == 4
    back = bpe.decode(made, bpe.tokenizer_source())
    assert {r["decoded"] for r in back.collect()} == {"", "hi " * 9000}
    assert bpe.encode(df.limit(0), bpe.tokenizer_source()).count() == 0


# ---- licenses
def plain_base(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    out = {}
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        places = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        if places:
            out[label] = places
    return words, out


def test_license_base_places():
    rng = random.Random(2)
    pieces = ["CC", "by", "cc by cc by", "General-Public", "License", "all RIGHTS reserved.", "é", "日本", "x_y", "\x7f", "{", "ccby", "4.0", "\n"]
    for _ in range(400):
        text = rng.choice(["", " "]).join(rng.choices(pieces, k=12)) + " " + " ".join(rng.choices(pieces, k=12))
        words, places = plain_base(text)
        assert [w.decode() for w in license_scan.words_of(text)] == words
        assert license_scan.base_places(license_scan.words_of(text)) == places


def test_license_templates(spark):
    notes = [t for _, t, _ in license_scan.TEMPLATES]
    labels = [x for x, _, _ in license_scan.TEMPLATES]
    filler = " ".join(f"filler{k}" for k in range(400))
    rows = [(i, f"{filler} {t.title()} {filler}") for i, t in enumerate(notes)]
    rows += [(100, filler), (101, "license software permission conditions version terms public"), (102, None), (103, ""), (104, "mit students license plates"), (105, "Licensed under the, Apache License; Version 2.0.")]
    rows += [(200 + k, filler) for k in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for i, label in enumerate(labels):
        assert label in got[i]["labels"].split(","), notes[i]
        assert got[i]["score"] > 0.9
    for i in (100, 101, 102, 103, 104, 210):
        assert got[i]["labels"] == "" and got[i]["score"] == 0.0
    assert got[105]["labels"] == "apache-2.0" and got[102]["n_words"] == 0 and got[102]["first_word"] is None
    assert license_scan.scan(df.limit(0)).count() == 0


def test_a_key_phrase_gives_the_label_whatever_stands_around_it(spark):
    rows = {
        1: ("MIT License", "mit"), 2: ("see Apache License 2.0 for details", "apache-2.0"), 3: ("// SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"), 4: ("/* SPDX-License-Identifier: CC-BY-SA-4.0 */", "cc-by,cc-by-sa-4.0"),
        5: ("Mozilla Public License, Version 1.1", "mpl-1.1"), 6: ("BSD 3-Clause", "bsd-3-clause"), 7: ("text (GPLv2)", "gpl-2.0"), 8: ("CC BY 3.0", "cc-by,cc-by-3.0"), 9: ("gnu Lesser General Public License", "gpl,lgpl"),
        10: ("in x permission is hereby granted, free of charge, y z to deal in the Software without restriction", ""), 11: ("mit einer license of the spdx kind, identifier unknown", ""), 12: ("license mit", ""),
    }
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id long, text string")).collect()}
    assert {i: r["labels"] for i, r in got.items()} == {i: want for i, (_, want) in rows.items()}
    assert got[1]["score"] == 1.0 and 0 < got[9]["score"] <= 1 and got[12]["score"] == 0.0


def test_license_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in license_scan.op10_license_scan(spark, SF).collect():
        words, places = plain_base(texts[r["doc_id"]])
        starts = sorted(p for own in places.values() for p in own)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(places)))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


# ---- HTML
def test_parser():
    flat = lambda n: [n.text] if n.tag == "#text" else [t for k in n.kids if not k.hidden for t in flat(k)]
    text = lambda page: flat(html_extract.parse(page))
    assert text("<p>a <b>b</b>c<p>d&amp;e &#233;&nbsp;f</p>") == ["a bc", "d&e é f"]
    assert text("<p><b>title<br><p>next") == ["title", "next"]
    assert text("<script>var a='<p>no</p>'</script>x<style>p{}</style><!-- <p>no --><p title='a>b'>y") == ["x", "y"]
    assert text("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>") == ["a", "b", "1", "2", "3"]
    assert text("a < b <3 <") == ["a < b <3 <"] and text("") == [] and text("<div") == [] and text("<!--x") == []
    assert "".join(text("</p>x</div></b>y")) == "xy"


def test_extraction_on_held_out_pages():
    trees = html_extract.model()
    scores = []
    for seed in range(9000, 9080):
        root = html_extract.parse(html_extract.training_page(seed))
        known = {}
        html_extract._unwrap(root, False, known)
        nodes, parents, rows = html_extract.flatten(root)
        kept = html_extract.decode(parents, *(t.odds(rows).tolist() for t in trees))
        state = dict(zip(range(len(nodes)), kept))
        size = [(len(n.text), known.get(id(n), False), k) for n, k in zip(nodes, kept) if n.tag == "#text"]
        tp, fp, fn = (sum(s for s, w, k in size if (w, k) == x) for x in ((True, True), (False, True), (True, False)))
        scores.append(2 * tp / max(1, 2 * tp + fp + fn))
        assert len(state) == len(parents)
    assert np.mean(scores) > 0.93


def test_decoding_is_consistent():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 30)
        parents = [-1, *(rng.randrange(k) for k in range(1, n))]
        kept = html_extract.decode(parents, [rng.uniform(-4, 4) for _ in range(n)], [rng.uniform(-3, 3) for _ in range(n)])
        assert len(kept) == n


def test_html_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as entities

    rows = html_extract.op9_html_extract(spark, SF).collect()
    assert len(rows) == len(pages)
    exact = 0
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        exact += r["text"] == " ".join(entities.unescape(re.sub("<[^>]+>", " ", article)).split())
    assert exact / len(rows) > 0.97


def test_html_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (3, "u", "<p>" + "word " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert [r["text"] for r in got][:3] == ["", "", ""] and len(got) == 4
    assert html_extract.extract(df.limit(0)).count() == 0


# ---- toxicity
def test_nn_pu_ranks_and_stays_non_negative():
    rng = np.random.default_rng(0)
    pos = [np.array([0, *rng.integers(2, 50, 5)]) for _ in range(300)]
    unl = [np.array([0, *rng.integers(2, 50, 5)]) if k % 10 == 0 else np.array([1, *rng.integers(2, 50, 5)]) for k in range(1500)]
    w, b = toxicity.nn_pu_fit(pos, unl, 50, 0.1)
    score = lambda row: 1 / (1 + np.exp(-(b + w[row].sum())))
    assert min(map(score, pos)) > 0.7 and max(score(r) for r in unl if r[0] == 1) < 0.5


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op1_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    tp = sum(r["predicted"] and r["toxic"] for r in rows)
    fp, fn = sum(r["predicted"] and not r["toxic"] for r in rows), sum(r["toxic"] and not r["predicted"] for r in rows)
    assert tp / max(1, tp + fp) > 0.97 and tp / max(1, tp + fn) > 0.85  # some labels there mark texts without any toxic word
    assert got.where((F.col("score") >= 0.7) != (F.col("predicted") == 1)).count() == 0
    ids = [r["doc_id"] for r in got.where("held_out").select("doc_id").limit(50).collect()]
    assert all(toxicity.held_out_id(i) for i in ids)


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(i, f"you idiot scum{'' if i % 2 else ' word'} {'alpha beta' if i % 3 else 'gamma'}", 0.1) for i in range(60)] + [(100 + i, f"calm words {i} here and there", 0.2) for i in range(200)] + [(500, None, 0.0), (501, "", 0.0), (None, "idiot", 0.0), (7, "twice", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["predicted"] == 1 for i in range(60) if i != 7) and all(by[100 + i]["predicted"] == 0 for i in range(200))
    assert by[500]["score"] == by[501]["score"] < 0.7
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id >= 100").count() == 202
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    none = toxicity.score_toxicity(docs, labels.limit(0))
    assert none.where("predicted = 1").count() == 0 and none.count() == docs.count()


# ---- mixing
def test_projected_gradient_meets_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.4], 800)
    n = rng.integers(1, 500, 800)
    members = spark.createDataFrame([(int(k), int(t), q.tolist()) for k, (t, q) in enumerate(zip(n, p))], "doc_id long, tokens long, posteriors array<double>").repartition(4)
    share = np.array([0.2, 0.5, 0.3])
    plan, present, wanted = mixing.fit_rates(members, share)
    r, _ = plan.rates(p)
    assert np.allclose(present, n @ p) and (r >= 0).all()
    assert np.abs((n * r) @ p / wanted - 1).max() < 0.01
    # brute force: gradient descent on the same objective over all rows at once
    plan, _, wanted = mixing.fit_rates(members, np.array([0.02, 0.9, 0.08]))
    total, x = n.sum(), np.ones(800)
    q = p @ plan.weight
    goal = wanted / total @ plan.weight
    for _ in range(4000):
        x = np.maximum(0, x - 0.5 * (q @ ((n / total * x) @ q - goal) + mixing.RIDGE * (x - 1)))
    loss = lambda r: 0.5 * (((n / total * r) @ q - goal) ** 2).sum() + mixing.RIDGE / 2 * (n / total * (r - 1) ** 2).sum()
    assert loss(plan.rates(p)[0]) <= loss(x) * 1.1 + 1e-5


@pytest.mark.parametrize("share, met", [([0.02, 0.48, 0.5], True), ([0.01, 0.49, 0.5], True), ([0.0005, 0.0005, 0.999], False)])
def test_small_targets_are_met_relative_to_themselves_or_reported(spark, caplog, monkeypatch, share, met):
    monkeypatch.setattr(mixing, "ITERATIONS", 50)
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.05, 0.05, 0.05], 3000)
    n = rng.integers(1, 500, 3000)
    members = spark.createDataFrame([(int(k), int(t), q.tolist()) for k, (t, q) in enumerate(zip(n, p))], "doc_id long, tokens long, posteriors array<double>").repartition(4)
    plan, _, wanted = mixing.fit_rates(members, np.array(share))
    reached = (n * plan.rates(p)[0]) @ p
    assert np.allclose(reached, plan.reached)
    assert (np.abs(reached / wanted - 1).max() < mixing.TOLERANCE) == met
    assert ("tokens wanted" in caplog.text) == (not met)


def test_mixing_to_given_targets(spark):
    docs = spark.createDataFrame([(i, "der die das und " * 5 if i % 4 == 0 else "the and of to in " * 4) for i in range(400)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "de" if i % 4 == 0 else "en") for i in range(100)], "id long, domain string")
    rows = mixing.mix(docs, labelled, targets={"de": 3, "en": 1}).collect()
    total = {d: sum(r["n_tokens"] * r["rate"] * r["posteriors"][k] for r in rows) for k, d in enumerate(("de", "en"))}
    assert abs(total["de"] / sum(total.values()) - 0.75) < 0.01
    assert all(abs(r["domain_reached"] / total[r["domain"]] - 1) < 1e-6 and abs(r["domain_reached"] / r["domain_wanted"] - 1) < 0.01 for r in rows)
    more = mixing.repeat_to_targets(docs, labelled, targets={"de": 1, "en": 1}).groupBy((F.col("doc_id") % 4 == 0).alias("de")).count().collect()
    assert abs({r["de"]: r["count"] for r in more}[True] / 300 - 1) < 0.1
    for bad in ({"fr": 1}, {"de": -1, "en": 2}, {"de": 0}, {"de": float("nan")}):
        with pytest.raises(ValueError):
            mixing.mix(docs, labelled, targets=bad)


def test_mixing_odd_tables(spark):
    docs = spark.createDataFrame([(i, "der die das und " * 5 if i % 4 == 0 else "the and of to in " * 5, 0.5) for i in range(200)] + [(900, None, 0.0), (901, "", 0.0), (None, "the", 0.0), (3, "again", 0.0)], "doc_id long, text string, rate double")
    labelled = spark.createDataFrame([(i, "de" if i % 4 == 0 else "en") for i in range(100)] + [(None, "de"), (5, None)], "id long, domain string")
    got = mixing.mix(docs, labelled)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == docs.count() and by[104]["domain"] == "de" and by[105]["domain"] == "en"
    assert by[104]["rate"] > by[105]["rate"] > 0 and by[900]["n_tokens"] == 0
    assert all(abs(sum(r["posteriors"]) - 1) < 1e-9 for r in by.values())
    more = mixing.repeat_to_targets(docs, labelled)
    assert more.columns == docs.columns and {r["doc_id"] for r in more.collect()} == set(by)
    assert mixing.mix(docs.limit(0), labelled).count() == 0 and mixing.repeat_to_targets(docs.limit(0), labelled).count() == 0
    alone = mixing.mix(docs, labelled.limit(0)).collect()
    assert {r["domain"] for r in alone} == {"all"}


# ---- pipeline
def test_pipeline_against_its_stages_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, steps = docs, []
    for name, stage in corpus_pipeline.STAGES:
        seen = corpus_pipeline.materialise(stage(spark, seen, sf), "step")
        steps.append(seen)
        if name != "bpe":
            assert seen.columns == docs.columns
    ids = [{r["doc_id"] for r in s.select("doc_id").distinct().collect()} for s in steps]
    assert ids[0] > ids[1] >= ids[2] == ids[3] == ids[4]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    # stage 2 by brute force: the largest id of each text
    best = {}
    for i in ids[0]:
        best[lower(texts[i])] = max(i, best.get(lower(texts[i]), -1))
    assert ids[1] == set(best.values())
    # stage 3 by brute force: no two that are left have a similarity of 0.8 by sets of five words, none went without one
    runs = {i: set(zip(*[lower(texts[i]).split()[k:] for k in range(5)])) for i in ids[1]}
    near = lambda a, b: len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]) and bool(runs[a])
    holders = {}
    for i, own in runs.items():
        for x in own:
            holders.setdefault(x, set()).add(i)
    mates = lambda i: {j for x in runs[i] for j in holders[x] if j != i and near(i, j)}
    gone = ids[1] - ids[2]
    assert all(mates(i) for i in gone if runs[i])
    wanted = {i for i in ids[1] if mates(i)}
    assert len([i for i in ids[2] if mates(i) & ids[2]]) <= 0.1 * max(1, len(wanted))
    # stage 4 repeats documents, stage 5 tokenises each row
    assert steps[3].count() >= steps[2].count() and steps[4].count() == steps[3].count()
    row = steps[4].first()
    own = bpe.ByteBpe(bpe.tokenizer_source())
    assert row["ids"] == np.frombuffer(own.encode(texts[row["doc_id"]]), "<i4").tolist() and row["n_tokens"] == len(row["ids"])
    assert corpus_pipeline.run(spark, SF).count() > 0
