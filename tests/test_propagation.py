"""Descriptions, tags and meta along the lineage, and annotations."""

import pytest
from pyspark.sql import functions as F

from tests.test_lineage import public
from tracewell import queries as Q
from tracewell import schemas
from tracewell.functions import text as tx
from tracewell.operators import annotate, inherit, settings


def world(spark, nodes, columns, lineage, given=()):
    """nodes: (name, kind, depth); columns: (model, column, text, tags, meta); given: (model, column, key, value)."""
    n = spark.createDataFrame([(f"m.{x}", x, x, k, "p", "d", "s", "sql", None, None, None, [], "", [], {}, {}, None, None, [], None, i) for i, (x, k, _) in enumerate(nodes)], schemas.NODES)
    c = spark.createDataFrame([(f"m.{m}", m, col, i, None, t, tags, meta, {}) for i, (m, col, t, tags, meta) in enumerate(columns)], schemas.COLUMNS)
    d = spark.createDataFrame([(f"m.{x}", depth) for x, _, depth in nodes], "unique_id string, depth int")
    s = spark.createDataFrame([(f"m.{m}", col, k, v) for m, col, k, v in given], "unique_id string, column string, key string, value string")
    return n, c, public(spark, lineage), d, s


def run(w, **kw):
    n, c, r, d, s = w
    out = inherit.inherited(c, r, n, d, s, **kw)
    return {(x.model, x.column): (x.description, x.tags, dict(x.meta)) for x in out.collect()}, out


CHAIN = [("src", "source", 0), ("stg", "model", 1), ("mart", "model", 2)]
LINES = [("stg", "a", "src", "a", {}), ("mart", "a", "stg", "a", {})]


def test_gaps_are_filled_through_copies(spark):
    w = world(spark, CHAIN, [("src", "a", "Truth", ["t"], {"o": "x", "renamed_from": "Q"}), ("stg", "a", "", [], {}), ("mart", "a", "", ["own"], {"o": "mine"})], LINES)
    got, out = run(w)
    assert got[("stg", "a")] == ("Truth", ["t"], {"o": "x", "desc-owner": "upstream"})
    assert got[("mart", "a")] == ("Truth", ["own", "t"], {"o": "mine", "desc-owner": "upstream"})
    n, _, r, d, s = w
    again = inherit.inherited(out, r, n, d, s)
    view = lambda x: sorted((y.model, y.column, y.description, y.tags, sorted(y.meta.items())) for y in x.collect())
    assert view(again) == view(out)


def test_own_text_stays_and_becomes_the_new_truth(spark):
    got, _ = run(world(spark, CHAIN, [("src", "a", "Old", [], {}), ("stg", "a", "New", [], {}), ("mart", "a", "", [], {})], LINES))
    assert got[("stg", "a")][0] == "New" and got[("mart", "a")][0] == "New"


def test_owned_upstream_is_overwritten(spark):
    got, _ = run(world(spark, CHAIN, [("src", "a", "Old", [], {}), ("stg", "a", "Stale", [], {"desc-owner": "upstream"}), ("mart", "a", "", [], {})], LINES, [("stg", "a", "desc-owner", "upstream")]))
    assert got[("stg", "a")][0] == "Old" and got[("mart", "a")][0] == "Old"


def test_a_copy_without_upstream_is_not_passed_on(spark):
    got, _ = run(world(spark, CHAIN, [("src", "a", "", [], {}), ("stg", "a", "Copy", [], {"desc-owner": "upstream"}), ("mart", "a", "", [], {})], LINES, [("stg", "a", "desc-owner", "upstream")]))
    assert got[("mart", "a")][0] == ""


@pytest.mark.parametrize("through,want", [(False, ""), (True, "Text")])
def test_renames_are_a_boundary(spark, through, want):
    got, _ = run(world(spark, CHAIN[:2], [("src", "a", "Text", ["t"], {}), ("stg", "b", "", [], {})], [("stg", "b", "src", "a", {"is_rename": True})]), through_renames=through)
    assert got[("stg", "b")][:2] == (want, ["t"])


@pytest.mark.parametrize("flag", ["is_aggregate", "is_window", "is_literal", "is_generated"])
def test_walls_inherit_nothing(spark, flag):
    got, _ = run(world(spark, CHAIN[:2], [("src", "a", "Text", ["t"], {"k": "v"}), ("stg", "a", "", [], {})], [("stg", "a", "src", "a", {flag: True, "is_computed": True})]))
    assert got[("stg", "a")] == ("", [], {})


def test_annotation_only_text_counts_as_empty(spark):
    got, _ = run(world(spark, CHAIN[:2], [("src", "a", "Text", [], {}), ("stg", "a", "Renamed from: X.Y", [], {})], LINES[:1]))
    assert got[("stg", "a")][0] == "Text"


def test_self_reference_and_unions(spark):
    nodes = [("s1", "source", 0), ("s2", "source", 0), ("u", "model", 1), ("h", "model", 1)]
    br = lambda *p: {"is_union": True, "union_branches": list(p)}
    columns = [("s1", "a", "Größe", [], {}), ("s2", "a", "groesse", [], {}), ("s1", "b", "One", [], {}), ("s2", "b", "Two", [], {}), ("u", "a", "", [], {}), ("u", "b", "", [], {}), ("h", "a", "Own", [], {})]
    got, _ = run(world(spark, nodes, columns, [("u", "a", None, None, br(("s1", "a"), ("s2", "a"))), ("u", "b", None, None, br(("s1", "b"), ("s2", "b"))), ("h", "a", "h", "a", {})]))
    assert got[("u", "a")][0] == "Größe" and got[("u", "b")][0] == "" and got[("h", "a")] == ("Own", [], {})


def test_skipping_tags_and_meta(spark):
    got, _ = run(world(spark, CHAIN[:2], [("src", "a", "T", ["t"], {"k": "v"}), ("stg", "a", "", [], {})], LINES[:1], [("stg", "a", "skip-add-tags", "true"), ("stg", "a", "skip-merge-meta", "true")]))
    assert got[("stg", "a")] == ("T", [], {"desc-owner": "upstream"})


def test_the_sample_project_is_stable(spark):
    f = Q.facts(spark)
    # A text that was filled over an old annotation is marked as upstream's in the pass after, when it equals it.
    first = Q.inherited_columns(spark)
    once = inherit.inherited(first, f.rows, f.project.nodes, f.depth, f.settings).cache()
    twice = inherit.inherited(once, f.rows, f.project.nodes, f.depth, f.settings)
    view = lambda x: sorted((y.model, y.column, y.description, y.tags, sorted(y.meta.items())) for y in x.collect())
    assert view(once) == view(twice)


def test_annotations_strip_to_what_they_were_added_to(spark):
    texts = ["A text", "", "Two\nlines", "has Literal in it"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    marked = F.concat("t", F.lit("\n\n"), annotate.block(F.lit("UNION here")))
    got = [r[0] for r in df.select(annotate.stripped(marked)).collect()]
    assert got == texts
    legacy = {"TRACEWELL -> Renamed from: A.B": "", "Text Windowed from: A.B": "Text", "x Aggregated in: M": "x", "x OLD: y": "x", None: ""}
    style = annotate.Style(legacy=("OLD:",))
    df = spark.createDataFrame([(t,) for t in legacy], "t string")
    assert [r[0] for r in df.select(annotate.stripped(F.col("t"), style)).collect()] == list(legacy.values())


def test_annotation_modes(spark):
    f = Q.facts(spark)
    from tracewell.operators import graph

    origins = graph.origins(f.rows, f.project.nodes)
    off = f.project.nodes.select("unique_id", F.lit("never").alias("mode"))
    out = annotate.annotated(f.project.columns, f.rows, origins, f.project.nodes, off, f.project.glossary)
    assert out.where(F.col("description").contains("TRACEWELL ->")).count() == 0 and out.count() == f.project.columns.count()
    row = out.where("model = 'customer_mart' AND column = 'segment'").head()
    assert row.description == "Market segment of a customer"
    on = off.withColumn("mode", F.lit("if_altered"))
    marked = annotate.annotated(f.project.columns, f.rows, origins, f.project.nodes, on, f.project.glossary, write_meta=True)
    by = {(r.model, r.column): r for r in marked.collect()}
    assert by[("stg_orders", "total")].meta["renamed_from"] == "ORDERS.O_TOTALPRICE"
    assert by[("order_flags", "version")].description.endswith("Literal set here") and by[("party_union", "name")].description.endswith("UNION here")
    assert by[("customer_rank", "rank_in_nation")].description.endswith("Windowed here") and by[("order_flags", "loaded_on")].description.endswith("Generated here")
    again = annotate.annotated(marked, f.rows, origins, f.project.nodes, on, f.project.glossary, write_meta=True)
    view = lambda x: sorted((y.model, y.column, y.description, sorted(y.meta.items())) for y in x.collect())
    assert view(again) == view(marked)


def test_by_name_nearest_ancestor_wins(spark):
    c = spark.createDataFrame([("g", "g", "customer_id", 0, None, "Far", ["f"], {"k": "far", "x": "1"}, {}), ("p", "p", "customerId", 0, None, "Near", ["n"], {"k": "near"}, {}), ("m", "m", "customer_id", 0, None, "", [], {}, {})], schemas.COLUMNS)
    a = spark.createDataFrame([("m", "m", 0), ("m", "p", 1), ("m", "g", 2)], "unique_id string, ancestor string, generation int")
    n = spark.createDataFrame([], schemas.NODES)
    r = inherit.by_name(c, n, a).where("unique_id = 'm'").head()
    assert (r.description, r.tags, dict(r.meta)) == ("Near", ["f", "n"], {"k": "near", "x": "1"})


def test_edges_merge_and_clean(spark):
    s = "unique_id string, column string, description string, tags array<string>, meta map<string,string>"
    far, near = spark.createDataFrame([("u", "a", "F", ["x"], {"k": "1"}), ("u", "b", "B", [], {})], s), spark.createDataFrame([("u", "a", None, ["y"], {"k": "2"})], s)
    got = {r.column: (r.description, r.tags, dict(r.meta)) for r in inherit.merge_edges(far, near).collect()}
    assert got == {"a": ("F", ["x", "y"], {"k": "2"}), "b": ("B", [], {})}
    c = inherit.clean_edges(spark.createDataFrame([("u", "a", "Undefined", [], {})], s)).head()
    assert (c.description, c.tags, c.meta) == (None, None, None)


def test_text_functions(spark):
    rows = [("Größe  \n X", "groesse x", True), ("", None, True), (None, "a", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", tx.equivalent(F.col("a"), F.col("b"))).collect())
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(tx.name_variants(F.lit("o_order_id"), F.lit("o_")))[:3] == ["order_id", "ORDER_ID", "orderId"]
    assert one(tx.without_blank_end(F.lit("a\r\n\r\n \r\n"))) == "a\r\n" and one(tx.without_comments(F.lit("a /* b\n */ -- c\n d"))) == "a d"
    assert one(tx.ratio(F.lit("customer_id"), F.lit("customerid"))) == 100.0
    assert one(tx.after_last_dot(F.lit("a.b.c"))) == "c" and one(tx.before_last_dot(F.lit("a.b.c"))) == "a.b" and one(tx.unquoted(F.lit('"x"'))) == "x"
    assert one(tx.map_text(tx.overlay(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))))) == "a=1;b=3"


def test_settings(spark):
    rows = [("node", "u", None, 4, "tracewell-sort-by", "x"), ("node", "u", None, 4, "sort_by", "y"), ("column", "u", "a", 1, "sort-by", "z"), ("node", "u", None, 9, "late", "v")]
    s = spark.createDataFrame(rows, schemas.SETTINGS)
    places = spark.createDataFrame([("u", "a"), ("u", "b")], "unique_id string, column string")
    got = {(r.column, r.key): r.value for r in settings.resolve(s, places).collect()}
    assert got == {("a", "sort-by"): "z", ("b", "sort-by"): "x"}
    assert ("b", "late") in {(r.column, r.key) for r in settings.resolve(s, places, extras=True).collect()}
    assert {r.chain for r in settings.chain(s).where("key = 'sort-by' AND column IS NULL").collect()} == {"4=x > 4=y"}
    t = spark.range(1).select(settings.property_value("auto", F.lit("m"), F.lit("{{ doc('x') }}")), settings.property_value("auto", F.lit("m"), F.lit("y")), settings.property_value("yaml", F.lit("m"), F.lit(None).cast("string"))).head()
    assert tuple(t) == ("{{ doc('x') }}", "m", "m")
