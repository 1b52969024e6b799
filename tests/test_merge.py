import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from helpers import fails

from tablesync import ColumnContract as C
from tablesync import ContractError, TableContract
from tablesync.operators import merge, watermark_advance

TABLE = TableContract(
    "s",
    "t",
    (
        C("k", "integer", nullable=False),
        C("a", "text"),
        C("b", "integer", default=7),
        C("c", "text", nullable=False, default="dflt"),
    ),
    primary_key=("k",),
)
SHAPES = ("split", "full_outer", "shuffle_split")
ALL = "k int, a string, b int, c string"


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "one", 1, "x"), (2, "two", 2, "x"), (3, None, 3, "x")], ALL)


def counts(outcome):
    return tuple(outcome.metrics.first())[1:]


def source(spark, data, schema="k int, a string"):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("shape", SHAPES)
def test_upsert(spark, rows, target, shape):
    done = merge(target, source(spark, [(2, None), (3, "three"), (4, "four")]), TABLE, shape=shape)
    assert rows(done.next_state) == [
        (1, "one", 1, "x"),
        (2, None, 2, "x"),  # a NULL overwrites
        (3, "three", 3, "x"),
        (4, "four", 7, "dflt"),  # defaults fill what the source does not supply
    ]
    assert counts(done) == (1, 2, 0)


@pytest.mark.parametrize("shape", SHAPES)
def test_full_sync(spark, rows, target, shape):
    done = merge(target, source(spark, [(2, "b"), (4, "d")]), TABLE, when_not_matched_by_source="delete", shape=shape)
    assert rows(done.next_state) == [(2, "b", 2, "x"), (4, "d", 7, "dflt")]
    assert counts(done) == (1, 1, 2)


@pytest.mark.parametrize("shape", SHAPES)
def test_full_sync_with_all_columns_is_the_source(spark, rows, target, shape):
    full = source(spark, [(2, "b", None, "y"), (9, "i", 9, "z")], ALL)
    done = merge(target, full, TABLE, when_not_matched_by_source="delete", shape=shape)
    assert rows(done.next_state) == [(2, "b", None, "y"), (9, "i", 9, "z")]
    assert counts(done) == (1, 1, 2)


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("by_source", ["ignore", "delete"])
def test_empty_source_changes_nothing(spark, rows, target, shape, by_source):
    done = merge(target, source(spark, []), TABLE, when_not_matched_by_source=by_source, shape=shape)
    assert rows(done.next_state) == rows(target)
    assert counts(done) == (0, 0, 0)


@pytest.mark.parametrize("shape", SHAPES)
def test_insert_new(spark, rows, target, shape):
    done = merge(target, source(spark, [(2, "b"), (4, "d")]), TABLE, when_matched="ignore", shape=shape)
    assert rows(done.next_state, "k", "a") == [(1, "one"), (2, "two"), (3, None), (4, "d")]
    assert counts(done) == (1, 0, 0)


@pytest.mark.parametrize("shape", SHAPES)
def test_update_only(spark, rows, target, shape):
    new = source(spark, [(2, "b"), (4, "d")])
    done = merge(target, new, TABLE, when_not_matched_by_target="ignore", shape=shape)
    assert rows(done.next_state, "k", "a") == [(1, "one"), (2, "b"), (3, None)]
    assert counts(done) == (0, 1, 0)


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("insert", [True, False])
def test_delete_matched(spark, rows, target, shape, insert):
    done = merge(
        target,
        source(spark, [(2, "b"), (4, "d")]),
        TABLE,
        when_matched="delete",
        when_not_matched_by_target="insert" if insert else "ignore",
        shape=shape,
    )
    assert rows(done.next_state, "k") == [(1,), (3,)] + [(4,)] * insert
    assert counts(done) == (int(insert), 0, 1)


@pytest.mark.parametrize("shape", SHAPES)
def test_delete_matched_and_target_only(spark, rows, target, shape):
    options = dict(when_matched="delete", when_not_matched_by_source="delete", shape=shape)
    done = merge(target, source(spark, [(2, "b"), (4, "d")]), TABLE, **options)
    assert rows(done.next_state, "k") == [(4,)]
    assert counts(done) == (1, 0, 3)


@pytest.mark.parametrize("shape", SHAPES)
def test_keep_matched_and_delete_the_rest(spark, rows, target, shape):
    options = dict(when_matched="ignore", when_not_matched_by_source="delete", shape=shape)
    # Repeats that match a row left alone are harmless.
    done = merge(target, source(spark, [(2, "b"), (2, "c"), (4, "d")]), TABLE, **options)
    assert rows(done.next_state, "k", "a") == [(2, "two"), (4, "d")]
    assert counts(done) == (1, 0, 2)


@pytest.mark.parametrize("shape", SHAPES)
def test_keys_only_source_updates_nothing(spark, rows, target, shape):
    done = merge(target, source(spark, [(2,), (5,)], "k int"), TABLE, shape=shape)
    assert rows(done.next_state, "k", "a") == [(1, "one"), (2, "two"), (3, None), (5, None)]
    assert counts(done) == (1, 0, 0)


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("data", [[(2, "b"), (2, "c")], [(8, "b"), (8, "c")]])
def test_repeated_source_key_fails(spark, target, shape, data):
    with fails("duplicate source keys"):
        merge(target, source(spark, data), TABLE, shape=shape).next_state.collect()


def test_repeated_new_key_fails_for_insert_new(spark, target):
    done = merge(target, source(spark, [(8, "b"), (8, "c")]), TABLE, when_matched="ignore")
    with fails("primary key clash"):
        done.next_state.collect()


def test_repeats_are_harmless_when_deleting(spark, rows, target):
    options = dict(when_matched="delete", when_not_matched_by_target="ignore")
    done = merge(target, source(spark, [(2, "b"), (2, "c")]), TABLE, **options)
    assert rows(done.next_state, "k") == [(1,), (3,)]
    assert counts(done) == (0, 0, 1)


@pytest.mark.parametrize("shape", SHAPES)
def test_null_key_matches_nothing_and_cannot_be_inserted(spark, rows, target, shape):
    with_null = source(spark, [(None, "n"), (2, "b")])
    done = merge(target, with_null, TABLE, when_not_matched_by_target="ignore", shape=shape)
    assert rows(done.next_state, "k", "a") == [(1, "one"), (2, "b"), (3, None)]
    with fails("NOT NULL"):
        merge(target, with_null, TABLE, shape=shape).next_state.collect()


@pytest.mark.parametrize("shape", SHAPES)
def test_null_in_required_column_fails(spark, target, shape):
    bad = source(spark, [(2, None)], "k int, c string")
    with fails("NULL in s.t.c"):
        merge(target, bad, TABLE, shape=shape).next_state.collect()


def test_condition_sees_both_sides(spark, rows, target):
    new = source(spark, [(1, "p"), (2, "q")])
    options = dict(when_not_matched_by_target="ignore")
    for condition in ("_target.b > 1 AND _source.a = 'q'", '_target."b" > 1', F.col("_target.b") > 1):
        done = merge(target, new, TABLE, condition=condition, **options)
        assert rows(done.next_state, "k", "a") == [(1, "one"), (2, "q"), (3, None)]
        assert counts(done) == (0, 1, 0)


@pytest.mark.parametrize("shape", SHAPES)
def test_key_match_with_false_condition_is_inserted_and_clashes(spark, target, shape):
    done = merge(target, source(spark, [(1, "p"), (9, "q")]), TABLE, condition="_target.b > 1", shape=shape)
    with fails("primary key clash"):
        done.next_state.collect()


def test_false_condition_under_full_sync_replaces_the_row(spark, rows, target):
    options = dict(condition="_target.b > 1", when_not_matched_by_source="delete")
    done = merge(target, source(spark, [(1, "p"), (2, "q")]), TABLE, **options)
    assert rows(done.next_state) == [(1, "p", 7, "dflt"), (2, "q", 2, "x")]
    assert counts(done) == (1, 1, 2)


def test_condition_without_update(spark, rows, target):
    options = dict(condition="_target.b > 1", when_matched="delete", when_not_matched_by_target="ignore")
    done = merge(target, source(spark, [(1, "p"), (2, "q"), (2, "r")]), TABLE, **options)
    assert rows(done.next_state, "k") == [(1,), (3,)]
    assert counts(done) == (0, 0, 1)


@pytest.mark.parametrize("shape", ("split", "shuffle_split"))
def test_other_keys_may_repeat_in_the_target(spark, rows, shape):
    target = spark.createDataFrame(
        [(1, "m", 1, "x"), (2, "m", 2, "x"), (3, None, 3, "x"), (4, "n", 4, "x")], ALL
    )
    new = source(spark, [(50, "m", 9), (60, "z", 8), (70, None, 5)], "k int, a string, b int")
    options = dict(keys=["a"], include_columns=["a", "b"], shape=shape)
    with fails("primary key clash"):  # two rows would take the key 50
        merge(target, new, TABLE, **options).next_state.collect()
    once = merge(target.where("k <> 2"), new, TABLE, **options)
    assert rows(once.next_state, "k", "a", "b") == [
        (3, None, 3),
        (4, "n", 4),
        (50, "m", 9),
        (60, "z", 8),
        (70, None, 5),
    ]
    assert counts(once) == (2, 1, 0)
    deleted = merge(target, new, TABLE, when_matched="delete", when_not_matched_by_target="ignore", **options)
    assert rows(deleted.next_state, "k") == [(3,), (4,)]
    inserted = merge(target, new, TABLE, when_matched="ignore", **options)
    assert rows(inserted.next_state, "k", "a", "b") == [
        (1, "m", 1),
        (2, "m", 2),
        (3, None, 3),
        (4, "n", 4),
        (60, "z", 8),
        (70, None, 5),
    ]


def test_column_choice(spark, rows, target):
    new = source(spark, [(2, "b", 20), (4, "d", 40)], "k int, a string, b int")
    want = [(1, "one", 1, "x"), (2, "b", 2, "x"), (3, None, 3, "x"), (4, "d", 7, "dflt")]
    assert rows(merge(target, new, TABLE, include_columns=["a"]).next_state) == want
    assert rows(merge(target, new, TABLE, exclude_columns=["b"]).next_state) == want
    for bad in (
        dict(include_columns=["a"], exclude_columns=["b"]),
        dict(include_columns=["nope"]),
        dict(exclude_columns=["nope"]),
        dict(include_columns=["c"]),
        dict(keys=["nope"]),
        dict(when_matched="nope"),
        dict(when_matched="ignore", when_not_matched_by_target="ignore"),
    ):
        with pytest.raises(ContractError):
            merge(target, new, TABLE, **bad)
    with pytest.raises(ContractError):
        merge(target, new.withColumn("nope", F.lit(1)), TABLE)


def test_source_is_cast_to_the_declared_types(spark, rows, target):
    new = source(spark, [("2", "22")], "k string, b string")
    assert rows(merge(target, new, TABLE).next_state, "k", "b") == [(1, 1), (2, 22), (3, 3)]
    with fails():
        merge(target, source(spark, [("2", "x")], "k string, b string"), TABLE).next_state.collect()


def test_watermark(spark, rows):
    columns = (C("id", "integer"), C("latest", "timestamp"), C("n", "text"))
    contract = TableContract("s", "acc", columns, ("id",), watermark_columns=("latest",))
    state = spark.createDataFrame([(1, "x"), (2, "y")], "id int, n string").withColumn(
        "latest", F.lit("2024-01-01").cast("timestamp_ntz")
    )
    later = F.lit("2024-02-01").cast("timestamp_ntz")
    moved = spark.createDataFrame([(2,), (3,)], "id int").withColumn("latest", later)
    done = watermark_advance(state, moved, contract, "latest")
    got = rows(done.next_state.select("id", F.col("latest").cast("string"), "n"))
    assert got == [(1, "2024-01-01 00:00:00", "x"), (2, "2024-02-01 00:00:00", "y")]
    with pytest.raises(ContractError):
        watermark_advance(state, moved, contract, "n")


small = st.dictionaries(st.integers(0, 8), st.sampled_from([None, "p", "q"]), max_size=8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(held=small, new=small)
def test_properties(spark, rows, held, new):
    target = spark.createDataFrame([(k, v, 0, "x") for k, v in held.items()], ALL)
    src = source(spark, list(new.items()))
    want = sorted((k, new.get(k, held.get(k))) for k in {*held, *new})
    states = []
    for shape in SHAPES:
        done = merge(target, src, TABLE, shape=shape)
        states.append(rows(done.next_state))
        inserted, updated, deleted = counts(done)
        assert (inserted + updated, deleted) == (len(new), 0)
    assert states[0] == states[1] == states[2]
    assert sorted(r[:2] for r in states[0]) == want
    again = merge(merge(target, src, TABLE).next_state, src, TABLE)
    assert rows(again.next_state) == states[0]
    assert counts(again)[0] == 0
    synced = merge(target, src, TABLE, when_not_matched_by_source="delete").next_state
    assert {r[0] for r in rows(synced)} == (set(new) or set(held))
