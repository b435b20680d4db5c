import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import gates, hashing, reward, text


def one(spark, value, **columns):
    """The value of an expression over one row."""
    names, values = list(columns), list(columns.values())
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'long'}" for n, v in columns.items())) if names else spark.range(1)
    return df.select(value.alias("v")).head()[0]


def test_hash_mod_equals_python(spark):
    df = spark.range(200).select("id", hashing.hash_mod(hashing.key("k-", F.col("id")), 97).alias("m"), hashing.hash_div_mod(hashing.key("k-", F.col("id")), 100, 4).alias("d"))
    for r in df.collect():
        h = int(hashlib.sha256(f"k-{r.id}".encode()).hexdigest(), 16)
        assert (r.m, r.d) == (h % 97, h // 100 % 4)


def test_sha_order_is_integer_order(spark):
    ids = [r.id for r in spark.range(50).orderBy(hashing.sha_order("x-", F.col("id"))).collect()]
    assert ids == sorted(range(50), key=lambda i: int(hashlib.sha256(f"x-{i}".encode()).hexdigest(), 16))


def test_schedule_keeps_weights():
    s = hashing.schedule()
    assert len(s) == 100 and [s.count(k) for k in range(6)] == hashing.PANEL_WEIGHTS


@pytest.mark.parametrize(("given", "want"), [("  A-B c! ", "a_b_c"), ("x" * 39 + " yz", "x" * 39 + "_"), ("__", ""), (" Q ", "q"), (None, None)])
def test_norm(spark, given, want):
    assert one(spark, text.norm(F.col("a")), a=given) == want


def test_toks_keep_repeats_and_case(spark):
    assert one(spark, text.toks(F.lit("the_Big_of_big_big"))) == ["Big", "big", "big"]


@pytest.mark.parametrize(("n", "reason"), [(24, "no_think"), (25, None)])
def test_think_gate_counts_words_of_any_white_space(spark, n, reason):
    words = " ".join(["w"] * (n - 1)) + " w"
    content = f"<think>{words}</think>" + '{"subject": ["one two"], "type": null}'
    assert one(spark, gates.faceted_gate(F.col("c")), c=content).reason == reason


def long_think(body):
    return "<think>" + "w " * 30 + "</think>" + body


@pytest.mark.parametrize(
    ("body", "reason"),
    [
        ("nothing", "no_json"),
        ('{"subject": ["a"],,}', "bad_json"),
        ('{"subject": []}', "subject_count:0"),
        ('{"subject": ["a", "A ", "b"]}', None),
        ('{"subject": ["a", "b", "c", "d"]}', "subject_count:4"),
        ('{"subject": ["a"], "type": 7}', "bad_type"),
        ('{"subject": ["a"], "audience": ["x"]}', "bad_audience"),
        ('{"subject": ["a"], "time": "  "}', None),
        ('{"subject": ["a"], "content_flags": "x"}', "bad_flags"),
        ('{"subject": ["a"], "content_flags": ["1", "2", "3", "4"]}', None),
        ('{"subject": ["a"], "content_flags": ["1", "2", "3", "4", "5"]}', "bad_flags"),
        ('```json\n{"subject": ["a"]}\n```', None),
        ('{"subject": "a"}', "bad_json"),
    ],
)
def test_faceted_gate(spark, body, reason):
    got = one(spark, gates.faceted_gate(F.col("c")), c=long_think(body))
    assert (got.reason, got.ok) == (reason, reason is None)


def test_missing_answer(spark):
    assert one(spark, gates.faceted_gate(F.col("c")), c=None).reason == "no_response"


def label(**changes):
    return {"topic": "legal", "scope": "group", "publicity": "public", "temporality": "current", "specificity": "named", "register_facet": "report"} | changes


@pytest.mark.parametrize(
    ("labels", "reason"),
    [
        ([], None),
        ([label()], None),
        ([label(topic="weather", scope="odd")], "off_topic:weather"),
        ([label(), label(scope="odd")], "off_facet:scope=odd"),
        ([label(topic=None)], "off_topic:None"),
        (["text"], "bad_json"),
        ([{"topic": "legal"}], "off_facet:scope=None"),
    ],
)
def test_ontology_gate(spark, labels, reason):
    assert one(spark, gates.ontology_gate(F.col("c")), c=long_think(json.dumps({"labels": labels}))).reason == reason


def test_openvocab_gate_counts_after_norm(spark):
    got = one(spark, gates.openvocab_gate(F.col("c")), c=long_think('{"topics": ["A b", "a-b", "!"], "tags": ["x"]}'))
    assert got.ok and got.value.topics == ["a_b"] and got.value.tags == ["x"]
    assert one(spark, gates.openvocab_gate(F.col("c")), c=long_think('{"topics": ["a"], "tags": []}')).reason == "tags_count:0"


GOOD = {"subject": ["data privacy"], "type": None, "audience": "staff", "time": "current", "purpose": None, "content_flags": []}


@pytest.mark.parametrize(
    ("changes", "ok"),
    [({}, True), ({"time": None}, True), ({"time": "soon"}, False), ({"type": "a_and_b"}, False), ({"type": "a, b"}, False), ({"subject": [1]}, False), ({"subject": [" "]}, False), ({"subject": ["a", None]}, False), ({"content_flags": ["a"] * 4}, False), ({"content_flags": None}, False)],
)
def test_card_gate(spark, changes, ok):
    assert (one(spark, gates.card_gate(F.col("c")), c=json.dumps(GOOD | changes)) is not None) == ok


def test_card_gate_wants_all_keys_and_stops_at_first_brace(spark):
    assert one(spark, gates.card_gate(F.col("c")), c=json.dumps({k: v for k, v in GOOD.items() if k != "purpose"})) is None
    assert one(spark, gates.card_gate(F.col("c")), c=json.dumps(GOOD | {"purpose": "a } b"})) is None


def test_repeated_keys_last_wins(spark):
    assert one(spark, gates.cli_card(F.col("c")), c='{"subject": ["a"], "subject": ["b"]}').subject == ["b"]


def test_cli_card_error(spark):
    got = one(spark, gates.cli_card(F.col("c")), c="x" * 300)
    assert got.error == "unparsed" and got.raw == "x" * 200


def test_grounding_rules(spark):
    low = F.lit("the running dogs met")
    g = lambda *s: one(spark, reward.grounding(F.array(*map(F.lit, s)), low))
    assert g("running") == 1.0 and g("runners") == 1.0 and g("cat") == 0.0 and g("do") == 0.0 and g("of_the") == 0.0 and g("RUNNING") == 0.0
    assert g("running_do", "cat") == 0.25


def card(subject, type_=None, audience=None, purpose=None, flags=()):
    s = lambda v: F.lit(v).cast("string")
    return F.struct(F.array(*map(F.lit, subject)).alias("subject"), s(type_).alias("type"), s(audience).alias("audience"), s(None).alias("time"), s(purpose).alias("purpose"), (F.array(*map(F.lit, flags)) if flags else F.array().cast("array<string>")).alias("content_flags"))


def test_nonredundant(spark):
    n = lambda c: one(spark, reward.nonredundant(c))
    assert n(card(["a1", "b1"])) == 1.0
    assert n(card(["x_y", "y_x"])) == 0.0
    assert n(card(["a1"], type_="A1")) == 0.75


def test_register_and_facet_prior(spark):
    generic, known = F.array(F.lit("report")), F.array(F.lit("report"), F.lit("tax"))
    r = lambda *s: round(one(spark, reward.register(F.array(*map(F.lit, s)), generic, known)), 6)
    assert r("tax_law") == round(0.4 + 0.35 + 0.125, 6) and r("report") == round(0.16 + 0.25, 6) and r("of") == 0.0
    vocabulary = {k: F.array(F.lit("tax_report")) for k in ("type", "audience", "purpose")}
    assert round(one(spark, reward.facet_prior(card(["a1"], "tax_report", None, "tax_law"), vocabulary)), 6) == round((1.0 + 0.3 + 0.25) / 3, 6)


def test_clamp_and_modes(spark):
    assert [one(spark, text.clamp(F.col("a")), a=a) for a in ("-1", "2", "9", "x")] == [0, 2, 3, None]
    assert one(spark, text.mode_prefix(F.lit("unseen:farming"))) == "unseen"


def test_truncate_words_and_listing(spark):
    assert one(spark, text.truncate_words(F.lit("a b c"), 2)) == "a b …" and one(spark, text.truncate_words(F.lit("a b"), 2)) == "a b"
    assert one(spark, text.listing(F.array(F.lit("x"), F.lit("y")))) == "[0] x\n[1] y"


def test_custom_ids(spark):
    assert one(spark, text.custom_id("C", F.lit(7), 4)) == "C-0007" and one(spark, text.custom_id("C", F.lit(123456), 4)) == "C-123456"
    assert one(spark, text.parse_custom_id(F.lit("EN-00042"))) == 42


def test_reasoning_field_wins(spark):
    assert one(spark, text.think(F.lit("<think>a</think>"), F.lit(" b "))) == "b" and one(spark, text.think(F.lit("<think>a</think>"), F.lit(" "))) == "a"


def test_candidate_cleanup(spark):
    assert one(spark, text.candidate(F.lit('<think>x</think> {"subject": ["a"]} more'))) == '{"subject": ["a"]}'
    assert one(spark, text.candidate(F.lit(" plain "))) == "plain"
