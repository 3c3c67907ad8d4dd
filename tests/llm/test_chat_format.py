import hashlib
import random

from bitgrove.llm import chat_format as cf


def test_escape_is_reversible_and_hides_marks():
    rng = random.Random(3)
    pieces = [*cf._CONTROL, "\\", "\\\\", "<", "|", "a", "é", "\U0001f600", "<\\|end|>", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        made = cf.escape(text)
        assert cf.unescape(made) == text
        assert not any(c in made for c in cf._CONTROL)


def test_marks_do_not_arise_across_the_edges_of_texts():
    rng = random.Random(4)
    pieces = [c[k:] for c in cf._CONTROL for k in range(len(c))] + [c[:k] for c in cf._CONTROL for k in range(len(c))]
    for _ in range(2000):
        turns = [("".join(rng.choices(pieces, k=2)), "".join(rng.choices(pieces, k=3))) for _ in range(3)]
        made = cf.render(turns)
        assert cf.read_back(made.text) == turns
        assert [cf.unescape(made.text[a:b]) for a, b in made.texts] == [t for _, t in turns]
        assert made.rewrites_at is None


def test_black_box_templates():
    plain = lambda turns: "".join(f"[{r}]{t}\n" for r, t in turns)
    made = cf.render([("u", "hi"), ("a", "")], plain)
    assert [made.text[a:b] for a, b in made.turns] == ["[u]hi\n", "[a]\n"]
    assert [made.text[a:b] for a, b in made.texts] == ["hi", ""]
    # a template that drops the thoughts of earlier assistant turns rewrites history
    def forgets(turns):
        return "".join(f"{r}:{t if k == len(turns) - 1 or r != 'a' else '...'};" for k, (r, t) in enumerate(turns))

    assert cf.render([("u", "q"), ("a", "think"), ("u", "more")], forgets).rewrites_at == 2
    assert cf.render([], plain) == cf.Rendered("", [], [], None)


def brute(turns):
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), h(told), len(loss), h(loss)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        convs.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in cf.op3_chat_format(spark, sf).collect()}
    assert got == {c: brute(t) for c, t in convs.items()}


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "a", "x"), (1, 1, "assistant", "a", "x"), (None, None, None, "n", "x"), (2, 5, "assistant", "é" * 70000, "x"), (2, 1, "user", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in cf.digests(cf.format_conversations(df)).collect()}
    assert got == {1: brute([("user", ""), ("assistant", "a"), ("assistant", "a")]), None: brute([("", "n")]), 2: brute([("user", ""), ("assistant", "é" * 70000)])}
    assert cf.format_conversations(df.limit(0)).count() == 0
