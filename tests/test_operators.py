"""Hand-computed values, edge cases and invariants."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline import plugins
from sieveline.functions import text as tx
from sieveline.functions import tokenizers as tok
from sieveline.functions import vectors as vec
from sieveline.operators import blocked, calls, chunking, context, evaluation, knowledge, lexical, memory, ranking, store, usage, vectors
from sieveline.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokenizers(spark):
    assert one(spark, tok.retrieval_tokens(F.lit("Été où le pâté réel a_b x"))) == ["le", "el", "a_b"]
    assert one(spark, tok.memory_tokens(F.lit("向量 BM25_x é a"))) == ["向", "量", "bm25_x", "a"]
    text = F.lit("NDCG 向量检索 a bm25 检")
    assert one(spark, tok.matching_tokens(text)) == one(spark, tok.duplicate_tokens(text)) == ["ndcg", "bm25", "向量", "量检", "检索"]
    assert one(spark, tok.token_estimate(F.lit("中文abcdeé"), F.lit(0.6), F.lit(0.3), F.lit(0.5))) == 4


def _docs(spark):
    return spark.createDataFrame([(0, "red apple pie"), (1, "green apple apple tart"), (2, "blue sky"), (3, "red sky at night")], "chunk_id long, text string")


@pytest.mark.parametrize("query,expected", [("red apple", [1.431336, 0.894989, 0, 0.633355]), ("apple apple", [1.431336, 1.789978, 0, 0])])
def test_bm25(spark, query, expected):
    asked = spark.createDataFrame([(7, query)], "query_id long, query string")
    rows = {r.chunk_id: r.score for r in lexical.bm25_top_k(_docs(spark), asked, 4).collect()}
    assert [round(rows[i], 6) for i in range(4)] == expected


def test_bm25_without_tokens(spark):
    asked = spark.createDataFrame([(7, "red")], "query_id long, query string")
    empty = spark.createDataFrame([(0, "!"), (1, None)], "chunk_id long, text string")
    assert [r.score for r in lexical.bm25_top_k(empty, asked, 4).collect()] == [0, 0]


def test_memory_search(spark):
    entries = spark.createDataFrame([(0, "deploy", "how to deploy", "run the script"), (1, "style", "code style", "use tabs")], "chunk_id long, name string, description string, content string")
    asked = spark.createDataFrame([(7, "deploy script"), (8, "  ")], "query_id long, query string")
    rows = lexical.memory_search(entries, asked).collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in rows] == [(0, 1.952092)]


def _lists(spark):
    kind = "query_id long, chunk_id string, score double, rank int"
    return spark.createDataFrame([(0, "a", 0.9, 1), (0, "b", 0.5, 2), (0, "c", 0.1, 3)], kind), spark.createDataFrame([(0, "b", 2.0, 1), (0, "d", 0.0, 2)], kind)


def test_fusion(spark):
    weighted = {r.chunk_id: round(r.score, 6) for r in ranking.fuse_weighted(*_lists(spark)).collect()}
    assert weighted == {"a": 0.7, "b": 0.614239, "d": 0.15, "c": 0}
    rrf = {r.chunk_id: round(r.score, 6) for r in ranking.fuse_rrf(*_lists(spark)).collect()}
    assert rrf == {"b": 0.032522, "a": 0.016393, "d": 0.016129, "c": 0.015873}


def test_mmr(spark):
    rows = [("m1", 1.0, 1, ["red", "apple", "pie"]), ("m2", 0.95, 2, ["red", "apple", "pie"]), ("m3", 0.6, 3, ["blue", "sky"]), ("m4", 0.5, 4, ["red", "sky"])]
    ranked = spark.createDataFrame([(0, *r) for r in rows], "query_id long, chunk_id string, score double, rank int, tokens array<string>")
    assert [r.chunk_id for r in ranking.mmr(ranked, 3).orderBy("rank").collect()] == ["m1", "m3", "m2"]


def test_rerank_blend(spark):
    rows = [(0, c, s, i + 1, p) for i, (c, s, p) in enumerate([("a", 0.9, 0.1), ("b", 0.8, 0.9), ("c", 0.7, 0.5), ("d", 0.2, 1.0)])]
    ranked = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int, p double")
    assert {r.chunk_id: round(r.score, 6) for r in ranking.rerank(ranked, "p").collect()} == {"a": 0.775, "b": 0.867857, "c": 0.660714, "d": 0.4}


def test_hash_embedding(spark):
    row = vectors.hash_embed(spark.createDataFrame([(0, "abc"), (1, None)], "id long, text string"), 8).orderBy("id").collect()
    assert [round(x, 6) for x in row[0].vector] == [0.547339, 0.552982, 0.558625, 0.167587, 0.165895, 0.164202, 0, 0]
    assert row[1].vector == [0.0] * 8
    assert one(spark, vec.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def _spans(frame):
    return [(r.start_offset, r.end_offset) for r in frame.orderBy("index").collect()]


def test_windows(spark):
    docs = spark.createDataFrame([("s", "x" * 2000)], "source string, text string")
    assert _spans(chunking.fixed_size(docs)) == [(0, 819), (819, 1638), (1638, 2000)]
    assert _spans(chunking.fixed_overlap(docs)) == [(0, 819), (768, 1587), (1536, 2000)]
    edge = spark.createDataFrame([("e", ""), ("n", None), ("b", " \n" * 700), ("o", "x")], "source string, text string")
    assert [r.id for r in chunking.fixed_size(edge).collect()] == ["o#0"] == [r.id for r in chunking.fixed_overlap(edge).collect()]


def test_recursive():
    text = "Alpha one.\n\nBeta two is here. Gamma three is longer! Delta 3.1 end?\n\nTail."
    assert [p for p, _, _ in chunking.recursive_paragraph(text, 40)] == ["Alpha one.", "Beta two is here. Gamma three is longer!", "Delta 3. 1 end?\n\nTail."]


MARKDOWN = "intro\n# A\none\n## B\n```py\n# not a heading\n\nx = 1\n```\nafter\n# C\n向量检索。\n```\nopen"


def test_chunks_leave_in_small_batches():
    text = "\n\n".join("word " * 150 for _ in range(8))
    docs = pa.RecordBatch.from_pydict({"source": [str(i) for i in range(600)], "text": [text] * 599 + [None]})
    found = list(chunking._pieces(iter([docs]), chunking.recursive_paragraph, 819.2, 1.6))
    assert max(sum(map(len, b.column("text").to_pylist())) for b in found) < chunking.BATCH_CHARS + 819
    assert len(found) >= 3 and sum(b.num_rows for b in found) == 599 * 8
    assert [r for b in found for r in b.column("id").to_pylist()] == [f"{d}#{i}" for d in range(599) for i in range(8)]


def test_markdown():
    section = [p for p, _, _ in chunking.markdown_section(MARKDOWN, 800)]
    assert [s.split("\n")[0] for s in section] == ["intro", "A", "A > B", "C"]
    aware = list(chunking.markdown_code_aware(MARKDOWN, 800))
    assert [p for p, _, _ in aware] == ["intro", "A\n\none", "A > B\n\n```py\n# not a heading\n\nx = 1\n```", "A > B\n\nafter", "C\n\n向量检索。", "C\n\n```\nopen"]
    assert MARKDOWN[aware[2][1] : aware[2][2]] == "```py\n# not a heading\n\nx = 1\n```"
    plain = "One para.\n\nTwo para.\n\nThree."
    assert list(chunking.markdown_section(plain, 20)) == list(chunking.markdown_code_aware(plain, 20)) == list(chunking.recursive_paragraph(plain, 20))
    long = "```\n" + "line\n" * 400 + "```"
    assert len(list(chunking.markdown_code_aware(long, 100))) == 1


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, i, i + 1, t) for i, t in enumerate([10, 20, 30, 0])], "query_id long, chunk_id long, rank int, token_estimate int")
    relevant = spark.createDataFrame([(0, 0), (0, 3)], "query_id long, chunk_id long")
    totals = spark.createDataFrame([(0, 2), (1, 0)], "query_id long, n_relevant long")
    rows = {r.query_id: r for r in evaluation.query_metrics(ranked.where("rank < 4"), relevant, totals).collect()}
    r = rows[0]
    assert (r.hit_rate, r.recall, round(r.precision, 6), r.mrr) == (1, 0.5, 0.333333, 1)
    assert math.isclose(r.ndcg, 1 / (1 + 1 / math.log2(3)))
    assert r.context_efficiency == 6
    assert list(rows[1])[1:] == [0, 0, 0, 0, 0, None]
    assert evaluation.macro_average(evaluation.query_metrics(ranked, relevant, totals).where("query_id > 5")).first().ndcg == 0


def test_containment_edges(spark):
    score = lambda a, b: one(spark, evaluation.containment_of(F.lit(a), F.lit(b)))
    assert score("alpha beta gamma delta", "alpha beta") == 0.5
    assert score("", "alpha") == 0
    assert score("向量检索", "向量检索系统") == 1


def test_matching_set_is_that_of_the_columns(spark):
    for text in ("NDCG 向量检索 a bm25 检 x数据y", "ÉTÉ ıI İstanbul K9 ſs ok-ok", "", None):
        assert tok.matching_set(one(spark, F.lower(F.lit(text).cast("string")))) == set(one(spark, tok.matching_tokens(F.lit(text).cast("string"))) or [])


def test_containment_groups_only_repeated_ids(spark):
    """Equal to the join of tokens, ids that repeat or are missing included; without those no pair is grouped."""
    texts = spark.createDataFrame([(1, "aa bb"), (2, "bb cc 数据检索"), (3, None), (4, "dd"), (4, "aa dd"), (None, "aa"), (None, "aa ee")], "chunk_id long, text string")
    golden = spark.createDataFrame([(1, "aa bb"), (1, "bb dd"), (1, "bb"), (2, "数据 cc ee"), (3, ""), (4, None), (None, "dd zz")], "query_id long, answer string")
    rows = lambda frame: sorted(map(str, frame.select("query_id", "chunk_id", "containment").collect()))
    assert rows(evaluation.containment(golden, texts)) == rows(evaluation._joined(golden, texts))
    assert rows(evaluation.containment(golden.where("false"), texts)) == []
    once = evaluation.containment(golden, texts.where("chunk_id < 4"))
    assert rows(once) == rows(evaluation._joined(golden, texts.where("chunk_id < 4")))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_answer_split_orders_only_the_sources_of_answers(spark):
    chunks = spark.createDataFrame([(s, i, x) for s in "abc" for i, x in enumerate(["one two ", "three four ", "five"])], "source string, index int, text string")
    golden = spark.createDataFrame([(1, "two three", "a"), (2, "one two", "a"), (3, "two three four five", "b"), (4, "two three", "none"), (5, "two three", None)], "query_id long, answer string, source string")
    found = evaluation.answer_split(golden, chunks)
    assert sorted(tuple(r) for r in found.collect()) == [(1, True), (2, False), (3, True), (4, False), (5, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")  # below the window


def test_golden_items_are_found_once(spark):
    """The matrix reads its items many times, but what finds them runs once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([("a", "red apples grow on old trees"), ("b", "blue whales swim")], "source string, text string")
    golden = spark.createDataFrame([(1, "red apples", "red apples grow", "a"), (2, "blue", "blue whales", "b")], "query_id long, query string, answer string, source string")
    cells = evaluation.matrix(docs, golden.mapInArrow(count, golden.schema), ("fixed-size",), ("rrf",), (None,)).collect()
    assert [(r.n_queries, r.recall) for r in cells] == [(2, 1.0)] and seen.value == 2


def test_budget_compaction(spark):
    rows = [(0, i, "tool" if i in (1, 3, 4) else "user", "t", s) for i, s in enumerate([10, 50, 5, 40, 60, 20])]
    frame = spark.createDataFrame(rows, "conv_id long, idx long, role string, tool string, size long")
    assert [r.idx for r in context.budget_compact(frame, 100).where("compacted").orderBy("idx").collect()] == [1, 3]


def test_truncation_and_edit(spark):
    assert one(spark, tx.truncate_middle(F.lit("abcdefghij"), 7)).startswith("abcd\n") and one(spark, tx.truncate_middle(F.lit("abcdefghij"), 7)).endswith("\nhij")
    assert one(spark, tx.replace_once(F.lit("a.b.c"), F.lit("."), F.lit("$1")))["outcome"] == "ambiguous"
    assert one(spark, tx.replace_once(F.lit("a.b"), F.lit("."), F.lit("$1")))["text"] == "a$1b"
    assert tx.glob_pattern("src/**/*.ts") == r"^src/.*/[^/]*\.ts$"
    assert one(spark, tx.extract_paths(F.lit("see src/a.ts, src/a.ts and b.md"))) == ["src/a.ts", "b.md"]
    assert one(spark, tx.slugify(F.lit("Hello, World! 你好"))) == "hello-world-你好"


def test_usage(spark):
    step = spark.createDataFrame([("claude-haiku-4-5", 1000, 200, 4000, 500)], "model string, fresh_input long, output long, cache_read long, cache_write long")
    r = usage.totals(step).first()
    assert [round(x, 6) for x in (r.cost, r.hit_rate, r.baseline, r.saved)] == [0.003025, 0.727273, 0.0065, 0.003475]
    assert usage.totals(step.where("false")).first().hit_rate == 0


def test_duplicates(spark):
    kind = "name string, type string, description string"
    found = memory.duplicates(spark.createDataFrame([("deploy steps", "user", "how to deploy")], kind), spark.createDataFrame([("deploy guide", "user", "how to ship"), ("deploy steps", "user", "x"), ("deploy guide", "project", "how to ship")], kind))
    assert [(r.name, r.score) for r in found.collect()] == [("deploy guide", 0.75)]


def test_loops(spark):
    rows = [(0, i, "t", "ab"[i % 2], "r") for i in range(9)] + [(1, i, "t", "a", "same") for i in range(12)]
    out = calls.detect(spark.createDataFrame(rows, "turn_id long, seq long, tool string, args_hash string, result_hash string"))
    verdicts = {(r.turn_id, r.seq): r.verdict for r in out.collect()}
    assert verdicts[0, 4] == "warning:ping_pong" and verdicts[0, 8] == "critical:ping_pong" and verdicts[0, 3] == "ok"
    assert verdicts[1, 5] == "warning:repeat" and verdicts[1, 8] == "critical:repeat" and verdicts[1, 10] == "critical:breaker"


def test_upserts(spark):
    kind = "id string, source string, seq long"
    old, new = spark.createDataFrame([("a#0", "a", 0), ("a#1", "a", 1), ("b#0", "b", 2)], kind), spark.createDataFrame([("a#0", "a", 0), ("c#0", "c", 1)], kind)
    order = lambda f: [r.id for r in f.orderBy("seq").collect()]
    assert order(store.upsert_in_place(old, new)) == ["a#0", "a#1", "b#0", "c#0"]
    assert order(store.upsert_at_end(old, new)) == ["a#1", "b#0", "a#0", "c#0"]
    assert order(store.upsert_at_end(old, new, True)) == ["b#0", "a#0", "c#0"]


def test_readers(spark, tmp_path):
    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "d" / "x.md").write_text("# hi")
    (tmp_path / "c" / "y.bin").write_text("no")
    assert [tuple(r) for r in readers.corpus(spark, str(tmp_path / "c")).collect()] == [("d/x.md", "# hi")]
    (tmp_path / "g.jsonl").write_text('// note\n\n{"id":"q1","query":"a","source":"s","goldenAnswer":"b","tags":["factoid"],"origin":"synth"}\n')
    assert readers.golden(spark, str(tmp_path / "g.jsonl")).first().goldenAnswer == "b"
    (tmp_path / "s.jsonl").write_text('{"type":"message","timestamp":"t","message":{"role":"user","content":"hi"}}\nbroken\n{"type":"other"}\n')
    assert [tuple(r) for r in readers.session(spark, str(tmp_path / "s.jsonl")).collect()] == [("t", "user", "hi")]
    notes = spark.createDataFrame([("a.md", "---\nname: n\ntype: user\nname: m\n---\n body \n"), ("b.md", "no"), ("c.md", "---\nname: n\ntype: odd\n---\nx")], "path string, text string")
    assert [(r.name, r.content) for r in readers.memories(notes).collect()] == [("m", "body")]


def test_small_functions(spark):
    assert one(spark, tx.percent(F.lit(0.256))) == "25.6%" and one(spark, tx.percent(F.lit(None).cast("double"))) == "∞"
    assert one(spark, tx.overwrite(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))) == {"a": 1, "b": 3}
    assert one(spark, tx.first_field(F.lit('{"b":{"c":4}}'), "$.a", "$.b.c")) == 4
    assert one(spark, tx.json_array(F.lit('x ["a","b"] y'))) == ["a", "b"] and one(spark, tx.json_array(F.lit("none"))) == []
    value = 0
    for c in "hello world, 你好":
        value = (value * 31 + ord(c)) & 0xFFFFFFFF
    value = abs(value - 2**32 if value >= 2**31 else value)
    assert int(one(spark, tx.rolling_hash(F.lit("hello world, 你好"))), 36) == value
    assert one(spark, tx.short_number(F.lit(1234))) == "1.2k"
    assert evaluation.report_name("x", True) == "mock-smoke.json"


def test_matrix_has_all_chunkers_and_tags(spark):
    """Every strategy of the reference's command by default, and each tag's averages in each cell."""
    docs = spark.createDataFrame([("a", "# one\n\nred apples grow on old trees\n\n```\ncode = 1\n```"), ("b", "# two\n\nblue whales swim in cold seas"), ("c", "green frogs sit on wet stones")], "source string, text string")
    rows = [(1, "red apples", "red apples grow on old trees", "a", ["factoid"]), (2, "blue whales", "blue whales swim in cold seas", "b", ["factoid", "multi-hop"]), (3, "brown bears", "brown bears eat sweet honey", "c", ["long-answer"])]
    golden = spark.createDataFrame(rows, "query_id long, query string, answer string, source string, tags array<string>")
    cells = evaluation.matrix(docs, golden).collect()
    assert {(r.strategy, r.fusion, r.reranking) for r in cells} == {(s, f, x) for s in chunking.STRATEGIES for f in ("weighted", "rrf") for x in ("none", "blend")} and len(cells) == 20
    for r in cells:
        assert [(t.tag, t.n_queries, t.recall) for t in r.by_tag] == [("factoid", 2, 1.0), ("long-answer", 1, 0.0), ("multi-hop", 1, 1.0)]
        assert (r.n_queries, round(r.recall, 6)) == (3, 0.666667)
    (bare,) = evaluation.matrix(docs, golden.where("false").drop("tags"), ("fixed-size",), ("rrf",), (None,)).collect()
    assert (bare.recall, bare.n_queries, bare.by_tag) == (0.0, 0, [])


def test_hybrid_search_embeds_in_full_width(spark):
    """By default, texts are embedded in as many dimensions as hash_embed has."""
    sizes = []

    def embed(texts, dims):
        sizes.append(dims)
        return vectors.hash_embed(texts, dims)

    chunks = spark.createDataFrame([(1, "red apples"), (2, "blue whales")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "red apples")], "query_id long, query string")
    assert ranking.hybrid_search(chunks, asked, embed=embed).orderBy("rank").first().chunk_id == 1
    assert sizes == [1024, 1024]


def test_synthetic_items(spark):
    reply = 'Sure: [{"query":"q1","goldenAnswer":"a1","tags":["factoid"]},{"query":"","goldenAnswer":"x","tags":[]},{"query":"q3","goldenAnswer":"a3","tags":[]}]'
    rows = evaluation.synthetic_items(spark.createDataFrame([(0, "s", reply), (1, "t", "no"), (2, "u", reply)], "seq long, source string, reply string")).collect()
    assert [(r.id, r.source, r.query) for r in rows] == [("syn-001", "s", "q1"), ("syn-002", "u", "q1")]


def test_listing(spark, tmp_path):
    (tmp_path / "l" / "d").mkdir(parents=True)
    (tmp_path / "l" / "d" / "x").write_text("1")
    (tmp_path / "l" / "y").write_text("two\nlines")
    assert {tuple(r) for r in readers.listing(spark, str(tmp_path / "l")).collect()} == {("d", "DIR"), ("y", "FILE")}
    assert readers.whole_file(spark, str(tmp_path / "l" / "y")).first().text == "two\nlines"


def test_blocked_ranking_equals_the_plain_plan(spark, monkeypatch):
    """Ties, zero vectors, lists of several lengths, ids that are texts, no queries: both plans give the same."""
    import random

    r = random.Random(3)
    rows = [(f"c{i:03d}", [float(r.randrange(-2, 3)) for _ in range(r.choice([3, 4, 5]))]) for i in range(120)] + [("z", [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(q, [float(r.randrange(-2, 3)) for _ in range(4)]) for q in range(5)] + [(9, [0.0] * 4)], "query_id long, vector array<double>")
    texts = spark.createDataFrame([(f"c{i:03d}", " ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "数据检索"]) for _ in range(r.randrange(0, 9)))) for i in range(150)] + [("n", None)], "chunk_id string, text string").repartition(4)
    golden = spark.createDataFrame([(1, "aa bb"), (2, "dd dd 数据检索"), (3, "zz"), (4, "")], "query_id long, query string").withColumn("answer", F.col("query"))
    entries = texts.select(F.col("chunk_id").alias("name"), F.expr("case when chunk_id like '%7' then null when chunk_id < 'c080' then 'p' else 'q' end").alias("type"), F.col("text").alias("description"))
    plans = {
        "cosine": lambda q: vectors.cosine_top_k(chunks, asked.where(q), 7),
        "knn": lambda q: vectors.knn_l2(chunks.where("size(vector) = 4"), asked.where(q), 7),
        "bm25": lambda q: lexical.best(texts, golden.where(q), 6),
        "keep": lambda q: lexical.bm25_top_k(texts, golden.where(q), 6),
        "hits": lambda q: evaluation.hits(golden.where(q), texts),
        "duplicates": lambda q: memory.duplicates(entries.where("name < 'c040'").where(q), entries),
    }
    run = lambda: {(n, q): sorted(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in x) for x in f(q).select(*sorted(f(q).columns)).collect()) for n, f in plans.items() for q in ("true", "false")}
    blocked_rows = run()
    monkeypatch.setattr(blocked, "MOST_CELLS", 0)
    assert run() == blocked_rows and len(blocked_rows["bm25", "true"]) > 10


def test_html_to_markdown(spark):
    pages = {
        "<html><head><title>T</title></head><body><h1 class='x'>A &amp; B</h1><p>one<br/>two</p></body></html>": "# A & B\n\none\ntwo",
        "<nav>menu</nav><h3>List</h3><ul><li>a</li><li><b>b</b></li></ul><footer>f</footer>": "### List\n\n- a\n- **b**",
        '<p>see <a class="y" href="http://e.org/?a=1&amp;b=2">the <em>site</em></a>.</p><script>var a = "<p>no</p>";</script>': "see [the _site_](http://e.org/?a=1&b=2).",
        "<pre><code>if a &lt; b:\n    c</code></pre><!-- gone --><div>end</div>": "```\nif a < b:\n    c\n```\n\nend",
        "<style>p {}</style>plain &quot;text&quot;&nbsp;here": 'plain "text" here',
        "": "",
    }
    for html, markdown in pages.items():
        assert one(spark, tx.html_to_markdown(F.lit(html))) == markdown, html


def test_stable_json(spark):
    assert one(spark, tx.stable_json(F.create_map(F.lit("b"), F.lit('x"y\\z'), F.lit("a"), F.lit(None).cast("string")))) == '{"a":null,"b":"x\\"y\\\\z"}'
    assert one(spark, tx.stable_json_text(F.lit('{"b": {"d": 1, "c": [2, {"z": "é\\"", "y": null}]}, "a": true}'))) == '{"a":true,"b":{"c":[2,{"y":null,"z":"é\\""}],"d":1}}'
    assert one(spark, tx.stable_json_text(F.lit("no json"))) is None


def test_windows_of_long_texts(spark):
    """Characters beyond the basic plane count once, and a long text is cut in time proportional to it."""
    text = "😀" * 1000 + " " * 2000 + "b" * 500
    docs = spark.createDataFrame([("s", text), ("n", None), ("e", "")], "source string, text string")
    for step, overlap in ((819, 0), (768, 32)):
        starts = [s for s in range(0, len(text), step) if s == 0 or s < len(text) - 819 + step] if overlap else list(range(0, len(text), step))
        expected = [(s, text[s : s + 819]) for s in starts if text[s : s + 819].strip()]
        found = chunking.fixed_size(docs, overlap=overlap).orderBy("index").collect()
        assert [(r.start_offset, r.text) for r in found] == expected and [r["index"] for r in found] == list(range(len(expected)))
        assert all(r.end_offset == min(r.start_offset + 819, len(text)) for r in found)
    long = spark.createDataFrame([("l", "word " * 400_000)], "source string, text string")
    assert chunking.fixed_size(long).count() == -(-2_000_000 // 819)


def test_numbered_in_ranges(spark):
    rows = spark.createDataFrame([(i * i % 97 if i % 9 else None, i) for i in range(300)], "k long, v long")
    found = store.numbered(rows, "k", "nth", parts=6).collect()
    assert sorted(r.nth for r in found) == list(range(1, 301))
    ordered = [r.k for r in sorted(found, key=lambda r: r.nth)]
    assert ordered == sorted(ordered, key=lambda k: (k is not None, k or 0))
    assert store.numbered(rows.where("false"), "k", "nth").count() == 0


def test_knowledge_base(spark, tmp_path):
    none = spark.createDataFrame([], "id string, source string, text string, vector array<double>, model string, seq long")
    docs = spark.createDataFrame([("b.md", "# two\n\nblue whales swim in cold seas"), ("a.md", "# one\n\nred apples\n\n```\ncode = 1\n```")], "source string, text string")
    base = knowledge.Base(none, dims=64).ingest(docs)
    assert [(r.seq, r.id) for r in base.chunks.orderBy("seq").collect()] == [(0, "a.md#0"), (1, "a.md#1"), (2, "b.md#0")]
    shorter = base.ingest(spark.createDataFrame([("a.md", "# one\n\ngreen pears")], "source string, text string"))
    assert [(r.seq, r.id) for r in shorter.chunks.orderBy("seq").collect()] == [(1, "a.md#1"), (2, "b.md#0"), (3, "a.md#0")]
    only = base.ingest(spark.createDataFrame([("a.md", "# one\n\ngreen pears")], "source string, text string"), replace_source=True)
    assert [r.id for r in only.chunks.orderBy("seq").collect()] == ["b.md#0", "a.md#0"]
    asked = spark.createDataFrame([(1, "blue whales")], "query_id long, query string")
    assert ("b.md", "two\n\nblue whales swim in cold seas") in {(r.source, r.excerpt) for r in shorter.search(asked, 3).collect()}
    flat = lambda query, text: F.when(text.contains("pears"), 1.0).otherwise(0.0)
    assert shorter.search(asked, 3, reranking="pure", scorer=flat, fusion=ranking.fuse_rrf).orderBy("rank").first().source == "a.md"
    assert sorted(r.source for r in base.sources().collect()) == ["a.md", "b.md"] and base.outdated().count() == 0
    report = evaluation.write_report(spark.createDataFrame([("fixed-size", 0.5)], "strategy string, ndcg double"), str(tmp_path), "x", True)
    assert report.endswith("mock-smoke.json") and spark.read.json(report).first().ndcg == 0.5
    assert store.select_text("users", "name=O'Hara=x", 3) == "SELECT * FROM users WHERE name = 'O''Hara' LIMIT 3" and store.select_text("t") == "SELECT * FROM t LIMIT 10"


def test_plugins(spark):
    class Plugin:
        name, gone = "p", False

        def activate(self, api):
            api.register_tools({"echo": lambda x: x})
            api.register("chunker", "whole", lambda docs, **_: docs)

        def destroy(self):
            self.gone = True

    manager, plugin = plugins.Manager(), Plugin()
    manager.activate(plugin)
    manager.activate(plugin)
    assert manager.tools["p__echo"](3) == 3 and "p__whole" in chunking.STRATEGIES
    manager.remove("p")
    assert not manager.tools and "p__whole" not in chunking.STRATEGIES and plugin.gone
    plugin.activate = lambda api: api.register("fusion", "x", 1 / 0)
    with pytest.raises(ZeroDivisionError):
        manager.activate(plugin)
    assert not manager.active
