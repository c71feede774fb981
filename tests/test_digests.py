"""Digest trees name exactly the keys that differ, and only differing nodes are read."""

from plantpulse.lifecycle import digests

SCHEMA = "id bigint, name string, note string, tags map<string,string>, at timestamp_ntz"


def table(spark, rows):
    return spark.createDataFrame([(i, n, o, t, None) for i, n, o, t in rows], SCHEMA)


def found(before, after):
    trees = [digests.digest_tree(t, ["id"]) for t in (before, after)]
    return sorted(((r.id is None, r.id), r.kind, r.rows_before, r.rows_after) for r in digests.differences(before, after, ["id"], *trees).collect())


BASE = [(i, f"n{i}", None, {"a": "1", "b": "2"}) for i in range(300)]


def test_equal_in_any_order_and_layout(spark):
    turned = [(i, n, o, {"b": "2", "a": "1"}) for i, n, o, t in reversed(BASE)]
    assert found(table(spark, BASE), table(spark, turned).repartition(7)) == []


def test_changes_are_named(spark):
    after = [r for r in BASE if r[0] != 5] + [(1000, "new", None, None), BASE[7]]
    after = [(i, None, n, t) if i == 9 else (i, n, "", t) if i == 11 else (i, n, o, {"a": "x"}) if i == 13 else (i, n, o, t) for i, n, o, t in after]
    assert found(table(spark, BASE), table(spark, after)) == [
        ((False, 5), "REMOVED", 1, 0), ((False, 7), "CHANGED", 1, 2), ((False, 9), "CHANGED", 1, 1), ((False, 11), "CHANGED", 1, 1),
        ((False, 13), "CHANGED", 1, 1), ((False, 1000), "ADDED", 0, 1)]


def test_null_keys_repeats_and_empty_tables(spark):
    one, two = [(None, "a", None, None)] * 2, [(None, "a", None, None), (None, "b", None, None)]
    assert found(table(spark, one), table(spark, two)) == [((True, None), "CHANGED", 2, 2)]
    assert found(table(spark, two), table(spark, two[::-1])) == []
    assert found(table(spark, []), table(spark, [])) == []
    assert found(table(spark, []), table(spark, one)) == [((True, None), "ADDED", 0, 2)]


def test_tree_sums_up(spark):
    tree = digests.digest_tree(table(spark, BASE), ["id"]).collect()
    for level in (0, 1, 2):
        assert sum(r.rows for r in tree if r.level == level) == 300
        assert sum(r.digest for r in tree if r.level == level) == sum(r.digest for r in tree if r.level == 0)


def test_stored_copies_read_only_what_differs(spark, folder):
    before, after = f"{folder}/before", f"{folder}/after"
    digests.save_copy(table(spark, BASE), ["id"], before)
    digests.save_copy(table(spark, [(i, n, "x" if i == 3 else o, t) for i, n, o, t in BASE]), ["id"], after)
    trees = [digests.read_tree(spark, p) for p in (before, after)]
    assert len(digests.differing_nodes(*trees)) == 1
    answer = digests.differences(digests.read_copy(spark, before), digests.read_copy(spark, after), ["id"], *trees)
    plan = answer._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__node" in plan
    assert [(r.id, r.kind) for r in answer.collect()] == [(3, "CHANGED")]
