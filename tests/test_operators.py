import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import assemble, catalog, evaluate, pairs, sampling, stats
from foliant.sources import readers, sinks
from foliant.streaming import gate as streaming


def docs(spark, rows):
    return spark.createDataFrame(rows, "i long, src string, id string, fp string, text string")


def test_quota_comes_before_dedup(spark):
    d = docs(spark, [(k, "mail", f"m{k}", "same", "t") for k in range(5)] + [(9, "pdf", "p", "same", "t")])
    top = sampling.quota_top(d, {"mail": 3, "pdf": 1})
    assert top.count() == 4
    kept = sampling.first_seen(top, "src_ord", "rank").collect()
    assert [r.src for r in kept] == ["mail"]


def test_quota_without_row_sources_and_ties(spark):
    assert sampling.quota_top(docs(spark, []), {"mail": 2}).count() == 0
    d = docs(spark, [(1, "other", "a", "f", "t"), (2, None, "b", "g", "t")])
    assert sampling.quota_top(d, {"mail": 2}).count() == 0


def test_samples_don_t_depend_on_partitions(spark):
    d = docs(spark, [(k, "mail", f"m{k}", f"f{k}", "t") for k in range(100)])
    a = {r.i for r in sampling.quota_top(d.repartition(1), {"mail": 10}).collect()}
    assert a == {r.i for r in sampling.quota_top(d.repartition(7), {"mail": 10}).collect()}


def test_window_group_limit_is_planned(spark):
    d = docs(spark, [(k, "mail", f"m{k}", f"f{k}", "t") for k in range(10)])
    plan = sampling.quota_top(d, {"mail": 3})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_rows_without_id_are_never_excluded_unless_strict(spark):
    d = docs(spark, [(1, "mail", None, "f1", "t"), (2, "mail", "x", "f2", "t")])
    used = spark.createDataFrame([("x",), (None,)], "id string")
    assert [r.i for r in sampling.excluding(d, used).collect()] == [1]
    assert sampling.excluding(d, used, used_fp=spark.createDataFrame([("f1",)], "fp string")).count() == 0


@pytest.mark.parametrize(("n", "ok"), [(199, False), (200, True), (20000, True), (20001, False)])
def test_length_gate(spark, n, ok):
    assert spark.range(1).select(sampling.length_gate(F.lit("😀" * n))).head()[0] is ok


def test_splits_are_disjoint_and_capped(spark):
    d = docs(spark, [(k, s, "", "", "t") for k, s in enumerate(["mail"] * 50 + ["log"] * 120)])
    got = {r[0]: r[1] for r in sampling.register_split(d, ["mail"]).groupBy("split").count().collect()}
    assert got == {"eval_id": 35, "train": 15, "eval_ood": 100, "drop": 20}


def test_oversampling(spark):
    d = docs(spark, [(1, "a", "", "", "t"), (2, "b", "", "", "t")])
    assert sampling.oversampled(d, F.col("src") == "a", 3).groupBy("i").count().orderBy("i").collect() == [(1, 3), (2, 1)]


def test_scores_with_empty_sides(spark):
    d = spark.createDataFrame([([], []), (["a"], []), ([], ["b"]), (["a", "a", "c"], ["a"])], "gold array<string>, pred array<string>")
    r = evaluate.set_scores(d).head()
    assert (r.tp, r.fp, r.fn, r.gold_empty, r.pred_empty, r.both_empty) == (1, 1, 2, 2, 2, 1)
    assert r.precision == 0.5 and abs(r.recall - 1 / 3) < 1e-12
    empty = evaluate.set_scores(d.limit(0)).head()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


def test_spearman(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, 1.0)], "x double, y double")
    p = d.toPandas()
    want = p.x.rank().corr(p.y.rank())
    r = evaluate.spearman(d, "x", "y").head()
    assert r.n == 4 and abs(r.rho - want) < 1e-9
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert evaluate.spearman(constant, "x", "y").head().rho == 0.0


@pytest.mark.parametrize(("n", "sizes"), [(4, [1, 1, 1, 1]), (7, [1, 1, 1, 4]), (10, [2, 2, 2, 4]), (3, [1, 1, 1])])
def test_quartiles_give_the_rest_to_the_last(spark, n, sizes):
    q = evaluate.quartiles(spark.range(n).select("id", F.col("id").cast("double").alias("v")), "v", "id").orderBy("quartile").collect()
    assert [r.n for r in q] == sizes


def test_upper_median(spark):
    r = evaluate.upper_median(spark.createDataFrame([(2.0,), (4.0,), (6.0,), (8.0,)], "gap double"), "gap").head()
    assert (r.n, r.least, r.median, r.greatest) == (4, 2.0, 6.0, 8.0)


def test_faithful_is_vacuous_on_empty_lists(spark):
    f = evaluate.faithful(F.array().cast("array<string>"), F.lit(0), F.array(F.lit(True)), F.array().cast("array<boolean>"))
    assert spark.range(1).select(f).head()[0] is True


def test_pairs(spark):
    card = lambda s: json.dumps({"subject": [s], "type": None, "audience": None, "time": None, "purpose": None, "content_flags": []})
    a, b, c = map(card, "abc")
    rows = [(1, [a, b, c], [5.0, 9.0, 9.0]), (2, [a, a], [1.0, 9.0]), (3, [a], [1.0, 2.0]), (4, [a, b], [5.0, 6.0]), (5, [], []), (6, [a, b], None), (7, [a, "not a card"], [1.0, 9.0]), (8, ["not a card", b], [1.0, 9.0])]
    got = {r.i: r for r in pairs.ranked_pairs(spark.createDataFrame(rows, "i long, candidates array<string>, scores array<double>")).collect()}
    assert (got[1].chosen, got[1].rejected, got[1].gap) == (b, a, 4.0) and (got[2].chosen, got[2].reason) == (a, None)
    assert [got[k].reason for k in (3, 4, 5, 6, 7, 8)] == ["parse", "margin", "parse", "parse", "malformed", "malformed"]


def test_unknown_grades_don_t_count(spark):
    rows = [("none", False, ["precise", "n/a", "great"], 0, [True] * 4, [], 0), ("none", True, None, None, None, None, None), ("unseen", True, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "mode string, failed boolean, grades array<string>, missed int, facet_ok array<boolean>, flags_ok array<boolean>, redundant int")
    got = {r.bucket: r for r in evaluate.facet_rollup(d).collect()}
    assert (got["none"].subject_precise, got["none"].docs, got["none"].failures, got["none"].faithful) == (1.0, 1, 1, 1.0)
    assert (got["unseen"].docs, got["unseen"].failures, got["unseen"].faithful) == (0, 1, 0.0) and (got["ALL"].docs, got["ALL"].failures) == (1, 2)


@pytest.mark.parametrize(("value", "true", "number"), [("true", True, 1), ("false", False, 0), ('"false"', True, None), ('""', False, None), ("0", False, 0), ("2.7", True, 2), ("-2.7", True, -2), ("null", False, None), ("[]", False, None), ("[null]", True, None), ("{}", False, None), ('{"a": 0}', True, None), ('" 12 "', True, 12), ('"1.5"', True, None)])
def test_truth_and_numbers_of_json(spark, value, true, number):
    from foliant.functions import verdicts

    v = F.parse_json(F.lit('{"x": ' + value + "}"))
    r = spark.range(1).select(verdicts.truth(F.try_variant_get(v, "$.x", "variant")).alias("t"), verdicts.whole(v, "$.x").alias("n")).head()
    assert (r.t, r.n) == (true, number)


def test_verdicts_that_fail(spark):
    from foliant.functions import verdicts

    texts = [None, "", "{", '{"missed": 1}', '{"subject_grades": "precise", "missed": 1, "facet_ok": {}}', '{"subject_grades": [], "missed": null, "facet_ok": {}}', '{"subject_grades": [], "missed": 1, "facet_ok": {}, "flags_ok": null}', '{"subject_grades": [7, "vague"], "missed": 99, "facet_ok": {}, "missed": 2}']
    got = [r.v for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, c string").orderBy("k").select(verdicts.facet_verdict(F.col("c")).alias("v")).collect()]
    assert [v.failed for v in got] == [True] * 7 + [False] and (got[7].grades, got[7].missed, got[7].flags_ok) == (["vague"], 2, [])


def test_orphans_and_long_ids(spark):
    d = spark.createDataFrame([("EN-1000000000000", 1), ("EN-00007", 2), ("EN-x", 3)], "c string, k int")
    from foliant.functions.text import parse_custom_id

    i = d.select(parse_custom_id(F.col("c")).alias("i"))
    assert [r.i for r in i.collect()] == [1000000000000, 7, None]
    joined, orphans = assemble.with_manifest(i.where("i is not null"), spark.createDataFrame([(7, "t")], "i long, text string"))
    assert [r.i for r in joined.collect()] == [7] and [r.i for r in orphans.collect()] == [1000000000000]


def test_observed_counts(spark):
    from pyspark.sql import Observation

    o = Observation()
    stats.observed(spark.createDataFrame([(True,), (False,), (True,)], "ok boolean"), o).write.format("noop").mode("overwrite").save()
    assert o.get == {"survivors": 2, "rejects": 1}


def test_long_reports_are_errors(spark):
    with pytest.raises(ValueError):
        sinks.report(spark.range(5), most=4)


def test_token_counts_take_a_term_once(spark):
    d = spark.createDataFrame([(["a_a_b", "the_a"],)], "subject array<string>")
    assert {r.token: r.n for r in stats.token_frequency(d).collect()} == {"b": 1}


def test_empty_anchor_is_no_anchor(spark):
    p = lambda a: spark.range(1).select(assemble.prompt("Base.", a)).head()[0]
    none = F.array().cast("array<string>")
    assert p(none) == p(F.lit(None).cast("array<string>")) == "Base." and "x, y" in p(F.array(F.lit("x"), F.lit("y")))


def test_positional_join_wants_equal_lengths(spark):
    with pytest.raises(ValueError):
        assemble.positional(spark.range(2), spark.range(3), "id")


def test_catalog_runs_a_model_in_batches(spark):
    class Upper:
        def __call__(self, texts):
            assert len(texts) <= 3
            return [t.upper() for t in texts]

    d = spark.createDataFrame([(k, f"t{k}") for k in range(10)] + [(10, None)], "i long, text string")
    got = {r.i: r.answers for r in catalog.generate(d, Upper, batch=3, copies=2).collect()}
    assert got[4] == ["T4", "T4"] and got[10] == ["", ""] and len(got) == 11


def test_calls_are_retried_and_never_lost(spark):
    d = spark.createDataFrame([(1, "ok"), (2, "busy"), (3, "bad"), (4, "raise")], "i long, prompt string")

    def call(p):
        if p == "raise":
            raise OSError
        return {"ok": (200, "yes"), "busy": (429, ""), "bad": (400, "")}[p]

    got = {r.i: (r.ok, r.reason) for r in catalog.called(d, call, pause=0.0).collect()}
    assert got == {1: (True, None), 2: (False, "err:exhausted"), 3: (False, "err:400"), 4: (False, "err:OSError")}


def test_sources(spark, tmp_path):
    import gzip

    (tmp_path / "a.jsonl").write_text('{"i": 1}\n\n{"i": 2}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"i": 3}\n')
    assert readers.json_lines(spark, f"{tmp_path}/a.jsonl", "i long").count() == 2
    assert readers.plain_or_gzip(spark, f"{tmp_path}/b.jsonl", "i long").head().i == 3
    assert readers.json_lines_or_empty(spark, f"{tmp_path}/none.jsonl", "i long").count() == 0
    for k in range(3):
        (tmp_path / f"t{k}.txt").write_text(f"text {k}")
    assert [r.text for r in readers.text_files(spark, f"{tmp_path}/t*.txt", 2).orderBy("name").collect()] == ["text 0", "text 1"]
    (tmp_path / "s.json").write_text(json.dumps({"a": [1, 2]}, indent=1))
    assert readers.json_document(spark, f"{tmp_path}/s.json").head().a == [1, 2]
    import io

    assert readers.standard_input(spark, io.StringIO(" \n")).count() == 0 and readers.standard_input(spark, io.StringIO("x")).head().name == "<stdin>"


def test_ticket_takes_six_comments_before_blanks_go(spark):
    comments = json.dumps([{"body": f"c{k}" if k not in (1, 3) else " "} for k in range(7)] + [{"body": 5}])
    issue = json.dumps({"summary": "s", "description": " d "})
    d = spark.createDataFrame([(issue, comments), (None, None), ("{", '"x"')], "a string, b string")
    got = [r[0] for r in d.select(readers.ticket_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["Issue: s\n\nd\n\nComment: c0\n\nComment: c2\n\nComment: c4\n\nComment: c5", "", ""]


def test_python_literals_become_json(spark):
    d = spark.createDataFrame([("{'a': None, 'b': True}",), ('{"a": 1}',), ("boom(",), (None,), ("'text'",)], "v string")
    assert [r[0] for r in d.select(readers.literal_to_json("v")).collect()] == ['{"a": null, "b": true}', '{"a": 1}', None, None, None]


def test_sinks(spark, tmp_path, capsys):
    d = spark.createDataFrame([(2, "b", "x"), (1, "é", "y")], "i long, t string, split string")
    sinks.write_json_lines(d, f"{tmp_path}/o", "i")
    assert [r.t for r in readers.json_lines(spark, f"{tmp_path}/o", "i long, t string").orderBy("i").collect()] == ["é", "b"]
    sinks.write_split(d, f"{tmp_path}/s", "split")
    assert (tmp_path / "s" / "split=x").exists()
    sinks.append(d, f"{tmp_path}/o")
    assert readers.json_lines(spark, f"{tmp_path}/o", "i long").count() == 4
    assert sinks.print_json_lines(d) == 2 and '"t":"b"' in capsys.readouterr().out
    assert "split" in sinks.report(d)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    from foliant.functions.gates import card_gate

    gate = lambda c: F.struct(card_gate(c).isNotNull().alias("ok"), F.when(card_gate(c).isNull(), "malformed").alias("reason"), card_gate(c).alias("value"))
    good = json.dumps({"subject": ["a"], "type": None, "audience": None, "time": None, "purpose": None, "content_flags": []})
    write = lambda name, rows: (tmp_path / "in").mkdir(exist_ok=True) or (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
    run = lambda: streaming.run_gate(streaming.read_answers(spark, f"{tmp_path}/in", "i long, content string"), gate, f"{tmp_path}/ok", f"{tmp_path}/no", f"{tmp_path}/cp", "i").awaitTermination()
    write("1.json", [{"i": 1, "content": good}, {"i": 2, "content": "x"}])
    run()
    write("2.json", [{"i": 1, "content": good}, {"i": 3, "content": good}])
    run()
    assert sorted(r.i for r in spark.read.schema("i long").parquet(f"{tmp_path}/ok").collect()) == [1, 3]
    assert [r.i for r in spark.read.schema("i long, reason string").parquet(f"{tmp_path}/no").collect()] == [2]


def test_dataset_limit_counts_scanned_rows(spark):
    d = spark.createDataFrame([(0, "x" * 10), (1, " " * 5 + "y" * 201), (2, "z" * 300)], "k long, text string")
    assert [r.name for r in readers.dataset(d, "d", "k", limit=2).collect()] == ["d#1"]


def test_fingerprint_prefers_digest_then_id(spark):
    f = lambda a, b: spark.range(1).select(readers.fingerprint(F.lit(a).cast("string"), F.lit(b).cast("string"), F.lit("{}"))).head()[0]
    assert f("s", "i") == "s" and f("", "i") == "i" and len(f(None, "")) == 64
