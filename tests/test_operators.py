import random

import pytest
from pyspark.sql import functions as F

from corroba.functions import text as T
from corroba.operators import recovery
from corroba.operators.chunking import ChunkSizes, chunks_of
from corroba.operators.claims import segment_line
from corroba.operators.graph import closure
from corroba.operators.ignore import DEFAULT_PATTERNS, IgnoreRules, owned_paths, prune, read_patterns, stack
from corroba.operators.inventory import requirement_name
from corroba.operators.planning import change_plan, timeout_ladder, under
from corroba.operators.ranking import greedy_budget
from corroba.operators.verdicts import RULES, judge


def chunked(blocks, sizes):
    """What packing should give, in plain Python."""
    out, texts, hint = [], [], None

    def joined():
        return "\n\n".join(texts)

    def flush():
        nonlocal texts, hint
        if joined().strip():
            out.append([joined().strip(), hint])
        texts, hint = [], None

    for text, new in blocks:
        if texts and len(joined()) + 2 + len(text) > sizes.most and len(joined()) >= sizes.least:
            flush()
        hint = new or hint
        texts.append(text)
        if len(joined()) >= sizes.target:
            flush()
    flush()
    if len(out) >= 2 and len(out[-1][0]) < sizes.tail:
        last = out.pop()
        out[-1] = [out[-1][0] + "\n\n" + last[0], last[1] or out[-1][1]]
    return [tuple(c) for c in out]


def test_chunks_follow_the_specification(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(60):
        blocks = [("x" * rng.randrange(1, 700), rng.choice([None, "", "A", "B"])) for _ in range(rng.randrange(1, 12))]
        rows += [(doc, i, t, h) for i, (t, h) in enumerate(blocks)]
        want[doc] = chunked(blocks, ChunkSizes())
    found = chunks_of(spark.createDataFrame(rows, "doc int, n int, text string, hint string"), "doc", "n", "text", F.col("hint"))
    got = {}
    for r in found.orderBy("doc", "chunk_index").collect():
        got.setdefault(r.doc, []).append((r.text, r.section_hint))
    assert got == want


def test_chunks_of_nothing(spark):
    empty = spark.createDataFrame([], "doc int, n int, text string, hint string")
    assert chunks_of(empty, "doc", "n", "text", F.col("hint")).count() == 0
    one = spark.createDataFrame([(1, 0, None, None), (1, 1, "a", "h")], "doc int, n int, text string, hint string")
    assert [(r.text, r.section_hint) for r in chunks_of(one, "doc", "n", "text", F.col("hint")).collect()] == [("a", "h")]


@pytest.mark.parametrize(
    ("text", "parts"),
    [("a, and b", ["a", "b"]), ("x but y and z, w", ["x", "y", "z", "w"]), ("a or b", ["a or b"]), (" ;.", [" ;."]), ("sand, andy", ["sand", "andy"])],
)
def test_claims_are_cut_step_by_step(spark, text, parts):
    assert spark.createDataFrame([(text,)], "t string").select(T.split_claim(F.col("t"))).first()[0] == parts


@pytest.mark.parametrize(
    ("text", "polarity", "modality"),
    [("you must not run", "negative", "must"), ("nothing", "positive", "descriptive"), ("it should work", "positive", "should"), ("no", "negative", "descriptive")],
)
def test_polarity_and_modality(spark, text, polarity, modality):
    n = T.norm("t")
    assert tuple(spark.createDataFrame([(text,)], "t string").select(T.polarity(n), T.modality(n)).first()) == (polarity, modality)


def test_segments_lose_their_marks(spark):
    rows = spark.createDataFrame([("- 1. a",), ("2) b",), ("* c",), ("-d",)], "t string")
    assert [r[0] for r in rows.select(T.clean(segment_line(F.col("t")))).collect()] == ["a", "b", "c", "d"]


def test_rules_cover_every_case(spark):
    assert len(RULES) == 28
    atoms = spark.createDataFrame([("exists_open", False, "positive"), ("exists_closed", False, "positive"), ("enum_contains", False, "negative")], "matcher string, hit boolean, polarity string")
    got = {r.matcher: r.result for r in judge(atoms).collect()}
    assert got == {"exists_open": "unresolved", "exists_closed": "contradicted", "enum_contains": "unresolved"}


def test_ignore_rules(spark):
    rules = IgnoreRules(stack(DEFAULT_PATTERNS, ["docs/*.txt"], unignore=["docs/keep.txt"]))
    cases = {"build/x.py": True, "src/build.py": False, "a/b/AGENTS.md": True, "docs/x.txt": True, "docs/keep.txt": False, "x.sqlite": True, "docs/a/x.txt": False, "README.md": True}
    rows = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: r.i for r in rows.select("path", rules.matches(F.col("path"), F.lit(False)).alias("i")).collect()}
    assert got == cases == {p: rules.is_ignored(p) for p in cases}
    assert {r.path for r in prune(rows, rules).collect()} == {p for p, i in cases.items() if not i}


def test_pattern_files():
    assert read_patterns(["# no", "", " a\\b ", "c/"]) == ["a/b", "c/"]
    assert owned_paths("/r", ["/r/site", "/r/", "/else", "/r/docs/"]) == ["docs/", "site/"]


def test_paths_and_plans(spark):
    rows = spark.createDataFrame([("src/a.py",), ("srcs/b",), ("notes/x.md",)], "path string")
    assert [r[0] for r in rows.select(under(F.col("path"), "src")).collect()] == [True, False, False]
    plan = change_plan(rows, [], ("src",), ("notes",), ("docs",), F.lit(False)).first()
    assert plan.reason == "source and reference changed" and plan.n_changed == 3


def test_timeouts(spark):
    assert spark.range(1).select(timeout_ladder(5, 60)).first()[0] == [5, 10, 20, 40, 60]


def test_budget_passes_by_what_does_not_fit(spark):
    rows = spark.createDataFrame([("s", 1, 10, 900), ("s", 2, 11, 900), ("s", 3, 12, 100)], "k string, o int, v int, n int")
    got = greedy_budget(rows, "k", ["o"], "v", "n", most=5, each=1000, total=1000).orderBy("place").collect()
    assert [(r.v, r.total) for r in got] == [(10, 900), (12, 1000)]


def test_budget_gathers_no_group(spark, monkeypatch):
    monkeypatch.setattr(F, "collect_list", None)
    rng = random.Random(8)
    rows = [(rng.choice(["s", "t", None]), rng.choice([None, 1, 2, 3]), rng.randrange(4), rng.choice([None, 0, 100, 300, 450, 2000])) for _ in range(80)]
    want = []
    for k in ("s", "t", None):
        spent = place = 0
        for o, n, v in sorted((-1 if o is None else o, 1000 if n is None else min(n, 1000), v) for key, o, v, n in rows if key == k):
            if place < 6 and spent + n <= 1050:
                spent, place = spent + n, place + 1
                want.append((k, v, place, spent))
    found = greedy_budget(spark.createDataFrame(rows, "k string, o int, v int, n int"), "k", ["o"], "v", "n", most=6, each=1000, total=1050)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    got = {r.node: r.parents for r in closure(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"b": ["a"], "c": ["b"], "a": ["c"]}


@pytest.mark.parametrize(
    ("raw", "k"),
    [('{"k": 1}', 1), ('x ```json\n{"k": 2}\n``` y', 2), ('so {"k": 3} it is', 3), ('{"k": 4', None), ("[1]", None), (None, None), ("", None)],
)
def test_json_recovery(spark, raw, k):
    v = recovery.json_object(F.col("t"))
    assert spark.createDataFrame([(raw,)], "t string").select(F.try_variant_get(v, "$.k", "bigint")).first()[0] == k


def test_lists_and_bullets(spark):
    rows = spark.createDataFrame([('["a", " b ", ""]',), ('"c"',), ("null",)], "t string")
    assert [r[0] for r in rows.select(recovery.string_list(F.try_parse_json("t"))).collect()] == [["a", "b"], ["c"], []]
    assert spark.createDataFrame([("- a\nno\n* b",)], "t string").select(recovery.bullets(F.col("t"))).first()[0] == ["a", "b"]


def test_requirement_names(spark):
    rows = spark.createDataFrame([("My_Pkg>=1; python_version<'3'",), ("a[b]",)], "t string")
    assert [r[0] for r in rows.select(requirement_name(F.col("t"))).collect()] == ["my-pkg", "a"]


@pytest.mark.parametrize("limit", [64 << 20, 200])
def test_containment_against_brute_force(spark, monkeypatch, limit):
    from corroba.operators import containment

    monkeypatch.setattr(containment, "BROADCAST_BYTES", limit)
    rng = random.Random(5)
    words = ["a", "b", "ab", "", "longer", "x" * 80, "x" * 70, "é", "c\nd"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(12))) for i in range(60)} | {100: None, 101: ""}
    passages = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(6))) for i in range(40)} | {100: None, 101: "", 102: "b", 103: "onge"}
    rows, asked = (spark.createDataFrame(list(x.items()), "id long, text string") for x in (texts, passages))
    got = sorted((r.id, r.p) for r in containment.holding(rows, "id", "text", asked.toDF("p", "passage"), "p", "passage").collect())
    assert got == sorted((i, p) for i, t in texts.items() for p, q in passages.items() if t is not None and q is not None and q in t)
    assert containment.holding(rows.limit(0), "id", "text", asked.toDF("p", "passage"), "p", "passage").count() == 0


def test_first_rows_that_hold_an_anchor(spark):
    from corroba.operators import containment

    rng = random.Random(6)
    stems = ["anchor", "hors", "chorus", "tion", "nation", "abcd"]
    texts = {i: " ".join(rng.choice(stems) + rng.choice(["", "s", "tion", "x"]) for _ in range(rng.randrange(5))) for i in range(80)} | {200: None}
    anchors = [(k, rng.choice(["anch", "hors", "tion", "nations", "abcdx", "none"])) for k in range(12) for _ in range(3)]
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    asked = spark.createDataFrame(anchors, "k long, anchor string")
    got = sorted((r.k, r.id, r.rank) for r in containment.first_holding(rows, "id", F.split("text", " "), asked, "k", "anchor", most=4).collect())
    want = []
    for k in {k for k, _ in anchors}:
        hits = sorted(i for i, t in texts.items() if t and any(a in t for x, a in anchors if x == k))
        want += [(k, i, r + 1) for r, i in enumerate(hits[:4])]
    assert got == sorted(want)


def test_segments_carry_their_section(spark):
    from corroba.operators.claims import segments

    rows = [(1, "a\n# One\n\nb\n## \nc\n#Two\nd"), (2, "x\ny # z"), (3, None), (4, ""), (5, "# only")]
    got = sorted((r.id, r.ordinal, r.section, r.line) for r in segments(spark.createDataFrame(rows, "id long, text string")).collect())
    assert got == [(1, 0, "Document", "a"), (1, 1, "One", "b"), (1, 2, "One", "c"), (1, 3, "Two", "d"), (2, 0, "Document", "x"), (2, 1, "Document", "y # z")]


def test_first_values_that_contain_a_word(spark):
    from corroba.operators.containment import first_containing

    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    values = {i: letters(rng.randrange(14)) for i in range(120)} | {500: None, 501: ""}
    for shortest in (0, 1, 3):
        words = [letters(rng.randrange(shortest, 6)) for _ in range(50)] + [None, "abcab", "zzz"]
        rows, asked = spark.createDataFrame(list(values.items()), "id long, v string"), spark.createDataFrame([(w,) for w in words], "w string")
        got = sorted((r.w, r.id) for r in first_containing(rows, "id", "v", asked, "w", most=5).collect())
        assert got == sorted((w, i) for w in {w for w in words if w is not None} for i in sorted(i for i, v in values.items() if v is not None and w in v)[:5])
    assert first_containing(rows, "id", "v", asked.limit(0), "w", 5).count() == 0
    assert first_containing(rows.limit(0), "id", "v", asked, "w", 5).count() == 0


def test_many_words_meet_many_values_without_all_pairs(spark):
    """100,000 words and as many values: each word is looked up, no word meets every value."""
    from corroba.operators.containment import first_containing

    values = spark.range(100_000).selectExpr("id", "concat('value of ', hex(id * 2654435761 % 4294967291), ' here') AS v")
    words = spark.range(100_000).selectExpr("hex((id + 50000) * 2654435761 % 4294967291) AS w")
    found = first_containing(values, "id", "v", words, "w", most=6)
    assert found.filter("id >= 50000").count() >= 50_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sections_go_in_the_order_of_the_answer(spark):
    from corroba.operators.answers import sections

    def told(raw):
        found = sections(spark.createDataFrame([(1, raw)], "id int, raw string"), ("Overview", "Risks"))
        return [(r.heading, r.blocks[0]["text"]) for r in found.orderBy("place").collect()]

    assert told('{"sections": {"Zeta": "first", "Alpha": "second"}}') == [("Overview", "first"), ("Risks", "second")]
    assert told('{"sections": {"Zeta": "gone", "Alpha": "second", "Zeta": "last"}}') == [("Overview", "last"), ("Risks", "second")]
    # empty bodies are passed by; one that is neither object nor list holds nothing
    assert told('{"section_blocks": {}, "section_bodies": [], "sections": {"risks": "r"}}') == [("Risks", "r")]
    assert told('{"section_blocks": "text", "sections": {"risks": "r"}}') == [("Overview", "No valid structured section bodies were returned.")]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_spread_tasks_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A file of one row group has all its rows in one partition, however many its bytes come to."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from corroba.operators import spread

    monkeypatch.setattr(spread, "ROWS", 500)
    sizes = {}
    for n in (4_000, 24_000):
        pq.write_table(pa.table({"id": list(range(n)), "text": [f"{i * 7919 % n} of {n}" for i in range(n)]}), tmp_path / f"{n}.parquet")
        rows = spread.spread(spark.read.parquet(str(tmp_path / f"{n}.parquet")).select("id"))
        each = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sorted(r.id for r in rows.collect()) == list(range(n))
        sizes[n] = max(each)
    assert max(sizes.values()) <= 2 * 500
    even = spark.range(0, 4_000, 1, 8)
    assert spread.spread(even) is even and spread.spread(spark.range(0)).count() == 0


def test_answers_of_a_large_file_are_dealt_to_small_tasks(spark, sf_dir, tmp_path, monkeypatch):
    """answer_sections over a file of one row group: no task has more than about ROWS answers."""
    import pyarrow.parquet as pq

    from corroba.operators import spread
    from corroba.plans import answers

    monkeypatch.setattr(spread, "ROWS", 100)
    events = pq.read_table(f"{sf_dir}/events.parquet").slice(0, 1_000)
    pq.write_table(events, tmp_path / "events.parquet")
    found = answers.answer_sections(spark, str(tmp_path)).select("event_id", F.spark_partition_id().alias("task")).distinct()
    each = [r["count"] for r in found.groupBy("task").count().collect()]
    assert sum(each) == events.num_rows and max(each) <= 2 * 100


def test_sections_look_each_value_up_once(spark):
    """Inside a lambda Spark computes an expression as often as it stands there; blocks had it a hundred times."""
    from corroba.operators.answers import sections

    odd = (
        '{"sections": [{"heading": "Risks", "blocks": null, "body": "lost"}, {"name": "overview", "content": [{"kind": "BULLET", "text": " ", "body": 4}, {"Text": "no", "kind": 3, "content": "c"}, null, [], "s"]}]}',
        '{"section_blocks": null, "section_bodies": 0, "sections": {"a.b": {"text": "t"}, "$x": [{"kind": "labeled_bullet", "text": "z", "label": null}], "q": 5}}',
    )
    found = sections(spark.createDataFrame(list(enumerate(odd)), "id int, raw string"), ("Overview", "Risks"))
    told = [(r.id, r.heading, [(b["kind"], b["text"], b["label"]) for b in r.blocks], r.codes) for r in found.orderBy("id", "place").collect()]
    kind, slot, label = "final_output.unsupported_block_kind_normalized", "final_output.unknown_section_recovered_into_missing_slot", "final_output.labeled_bullet_missing_label_normalized"
    assert told == [
        (0, "Overview", [("bullet", "4", ""), ("paragraph", "c", ""), ("paragraph", "s", "")], [kind]),
        (1, "Overview", [("labeled_bullet", "z", "Note")], [slot, label]),
    ]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get") <= 40
