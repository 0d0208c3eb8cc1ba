"""Formatting: reversible escapes, spans found from renderings alone, long and hot conversations."""

import hashlib
import random

import pytest

from tallyforge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[TURN]", "[\\INST]", "</\\\\s>", "[", "]", "<", ">", "/", "\\", " ", "\n", "é", "s", "INST", ""]


def plain(turns):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned), len(chat.Marked()(turns))


def digests(spark, df, path, **options):
    chat.write(df, str(path), **options)
    return {r["conv_id"]: tuple(r)[1:] for r in chat.digest(chat.read(spark, str(path))).collect()}


def test_reads_back():
    rng, template = random.Random(3), chat.Marked()
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool\n[INST]\\n", "a\\"]), "".join(rng.choices(CONTROL, k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]
        text = template(turns)
        assert template.read(text) == turns
        assert not any(m in template.escape(t) for _, t in turns for m in ("[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]"))
    with pytest.raises(ValueError):
        template.read("[INST] open")


def test_spans_of_black_boxes():
    """Templates that the library knows nothing of: marks that depend on what came before, and one that rewrites."""

    def numbered(turns):
        return "<begin>" + "".join(f"\n#{k} {r.upper()}: {t}!" for k, (r, t) in enumerate(turns))

    seen, whole = chat.Prefixes(numbered), "<begin>"
    for role, text in [("user", "0"), ("assistant", "1"), ("assistant", ""), ("user", "0101")]:
        added, a, b = seen.add(role, text)
        assert added[a:b] == text
        whole += added
    assert whole == seen.rendered == numbered(seen.turns)

    def forgets(turns):
        return "".join(t for r, t in turns[:-1] if r != "think") + "".join(t for _, t in turns[-1:])

    seen = chat.Prefixes(forgets)
    assert [seen.add(r, t) is None for r, t in [("user", "a"), ("think", "b"), ("assistant", "c")]] == [False, False, True]
    swallow = chat.Prefixes(lambda turns: "x" * len(turns))
    assert swallow.add("user", "a") is None


def test_rewriting_conversations(spark):
    def last_only(turns):
        return "".join(f"({t})" if k == len(turns) - 1 or r != "assistant" else "(..)" for k, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "long"), (1, 2, "user", "r"), (2, 0, "user", "q"), (2, 1, "assistant", "a")], SCHEMA)
    got = {r["conv_id"]: r for r in chat.rendered(df, last_only).collect()}
    assert (got[1]["rewrites"], got[1]["text"], got[1]["mask"]) == (1, "(q)(..)(r)", [])
    assert got[2]["rewrites"] == 0 and [got[2]["text"][s["start"] : s["stop"]] for s in got[2]["mask"]] == ["a"] and len(got[2]["turns"]) == 2
    last_only.alone = True
    row, seen = chat._Row(1, True), chat.Prefixes(last_only)
    row.add(seen, "assistant", "long", "assistant")
    with pytest.raises(ValueError, match="stand alone"):
        row.add(seen, "user", "r", "assistant")


def test_odd_turns(spark, tmp_path):
    """Nulls, ties, repeats, missing ids, odd roles and a long conversation over several rows and ranges."""
    rng = random.Random(4)
    rows = [(None, None, None, None), (None, 3, "user", "x"), (2, 1, "user", None), (2, 0, "assistant", "</s>"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "assistant", "c"), (3, 0, "user", "a"), (4, 0, "tool\n1", "[TURN]"), (5, 0, "assistant", "é" * 200_000), (6, 0, "", "")]
    rows += [(9, k, rng.choice(["user", "assistant"]), "".join(rng.choices(CONTROL, k=8))) for k in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as part", "'clash' as tie", "'clash' as mask").repartition(5)
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))
        want[conv] = plain([(r[2] or "", r[3] or "") for r in own])
    assert digests(spark, df, tmp_path / "a") == want
    assert digests(spark, df, tmp_path / "b", row_chars=50) == want
    pieces = chat.read(spark, str(tmp_path / "b")).where("conv_id = 9")
    assert pieces.select("part").distinct().count() > 1 and pieces.count() > 20 and pieces.where("first and last").count() == 0
    assert digests(spark, df.where("false"), tmp_path / "c") == {}


def test_hot_conversation(spark, tmp_path):
    """A third of all turns under one id at one place, equal in every column: still several tasks' work."""
    rows = [(1, 1, "assistant", "same")] * 600 + [(k, 0, "user", str(k)) for k in range(100, 1300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = digests(spark, df, tmp_path / "a")
    assert got[1] == plain([("assistant", "same")] * 600) and len(got) == 1201
    assert chat.read(spark, str(tmp_path / "a")).where("conv_id = 1").select("part").distinct().count() > 1
