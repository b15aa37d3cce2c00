"""Tables on small fixtures: tiers, writes, schema changes, maintenance, errors."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType

from sedimenta.errors import Conflict, InvalidInput, NotFound, NotSupported
from sedimenta.functions.rowid import ROW_ID
from sedimenta.operators import maintenance, sql
from sedimenta.operators.table import Partition
from sedimenta.sources.catalog import Client

PEOPLE = StructType([StructField("name", StringType(), False), StructField("age", IntegerType(), False)])


@pytest.fixture(scope="module")
def client(spark):
    c = Client(spark)
    c.create_namespace("test")
    return c


@pytest.fixture
def people(client, spark, request):
    """Four people, three dumped to a file and one inline."""
    t = client.create_table("test", request.node.name, PEOPLE, config={"inline_row_count_limit": 3})
    t.insert(spark.createDataFrame([("Alice", 20), ("Bob", 21)], PEOPLE).coalesce(1))
    t.insert(spark.createDataFrame([("Charlie", 22), ("David", 23)], PEOPLE).coalesce(1))
    return t


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tiers(people):
    assert (people.inline_row_count(), people.data_file_count(), people.count()) == (1, 1, 4)
    assert people.data_file_records()[0]["live"] == 3
    assert people.size() > 0


def test_scan(people):
    assert rows(people.scan(["age"])) == [(20,), (21,), (22,), (23,)]
    assert rows(people.scan(filters=["age > 21", F.col("name") == "Charlie"])) == [("Charlie", 22)]
    assert [tuple(r) for r in people.scan(offset=1, limit=2).collect()] == [("Bob", 21), ("Charlie", 22)]
    assert people.scan(limit=0).count() == 0
    assert people.df().columns == ["name", "age"]
    ids = [bytes(r[ROW_ID]) for r in people.rows().collect()]
    assert len(set(ids)) == 4 and all(len(i) == 16 and i[6] >> 4 == 7 for i in ids)
    for bad in ({"projection": []}, {"batch_size": 0}, {"limit": -1}, {"filters": ["age + 1"]}):
        with pytest.raises(InvalidInput):
            people.scan(**bad)
    with pytest.raises(NotFound):
        people.scan(["nothing"])


def test_update(people):
    ids = {r["name"]: bytes(r[ROW_ID]) for r in people.rows().collect()}
    assert people.update({"age": F.lit(30)}, "name = 'Alice'") == 1
    assert people.update({"age": "age + 1"}, F.col(ROW_ID) == F.lit(bytearray(ids["Bob"]))) == 1
    assert people.update({"age": "age"}, "name = 'nobody'") == 0
    assert rows(people.df()) == [("Alice", 30), ("Bob", 22), ("Charlie", 22), ("David", 23)]
    assert {r["name"]: bytes(r[ROW_ID]) for r in people.rows().collect()} == ids
    assert people.update({"age": "age + 1"}, "name = 'Alice'") == 1  # moved once, moves again
    assert rows(people.scan(["age"], ["name = 'Alice'"])) == [(31,)]
    with pytest.raises(Exception, match="age is NULL"):
        people.update({"age": F.lit(None)}, "name = 'Bob'")
    with pytest.raises(NotFound):
        people.update({"nothing": "1"})


def test_delete(people):
    assert people.delete("1 = 2") == 0
    assert people.delete("cast(null as boolean)") == 0
    assert people.delete("age > 22 or name = 'Alice'") == 2
    assert people.count() == 2 == people.df().count()
    assert people.delete(True) == 2
    assert people.count() == 0 and people.df().count() == 0 and people.df().columns == ["name", "age"]


def test_statements(people, spark):
    assert sql.insert_into(people, spark.createDataFrame([(24, "Tom")], "age int, name string")).collect()[0]["count"] == 1
    assert sql.delete_from(people, "age > 21", "age < 24").collect()[0]["count"] == 2
    assert sql.update_table(people, {"age": "age + 1"}).collect()[0]["count"] == 3
    assert rows(people.df()) == [("Alice", 21), ("Bob", 22), ("Tom", 25)]
    sql.register(people, "people_now")
    assert spark.sql("select count(1) from people_now where age > 21").first()[0] == 2
    with pytest.raises(NotSupported):
        sql.insert_into(people, people.df(), mode="replace")


def test_alter(people):
    people.add_column(StructField("new_col", StringType()), "'default_value'")
    assert people.scan(filters=["new_col = 'default_value'"]).count() == 4
    with pytest.raises(InvalidInput):
        people.add_column(StructField("other", IntegerType()), "'text'")
    people.rename_column("name", "who")
    people.drop_column("age")
    people.drop_column("not there")
    assert rows(people.df())[0] == ("Alice", "default_value") and people.df().columns == ["who", "new_col"]
    people.rename("alter_renamed")
    assert people.client.load_table("test", "alter_renamed").count() == 4
    with pytest.raises(NotFound):
        people.client.load_table("test", "test_alter")


def test_insert_rules(people, spark):
    with pytest.raises(InvalidInput):
        people.insert(spark.createDataFrame([("x", 1)], "name string, age long"))
    with pytest.raises(InvalidInput):
        people.insert(spark.createDataFrame([("x",)], "name string"))
    with pytest.raises(InvalidInput):
        people.insert(spark.createDataFrame([("x", 1, 2)], "name string, age int, more int"))
    with pytest.raises(Exception, match="name is NULL"):
        people.insert(spark.createDataFrame([(None, 1)], "name string, age int"))
    people.insert(spark.createDataFrame([("it's \"x\"; drop", 1)], "name string, age int"))
    assert people.scan(filters=[F.col("name") == "it's \"x\"; drop"]).count() == 1


def test_partitions(client, spark):
    t = client.create_table("test", "parts", PEOPLE, config={"inline_row_count_limit": 2})
    for a, b in ((("Alice", 1), ("Bob", 2)), (("Charlie", 3), ("David", 4))):
        t.insert(spark.createDataFrame([a, b], PEOPLE).coalesce(1))
    t.insert(spark.createDataFrame([("Eva", 5)], PEOPLE))
    names = [[r[0] for r in rows(t.scan(["name"], partition=Partition(i, 2)))] for i in range(2)]
    assert names == [["Alice", "Bob", "Eva"], ["Charlie", "David"]]
    assert t.scan(partition=Partition(2, 3)).count() == 0
    assert t.count([Partition(i, 3) for i in range(3)]) == [3, 2, 0]
    with pytest.raises(InvalidInput):
        Partition(3, 3)
    parts = t.partitions(4)
    assert [len(p.files) for p in parts] == [1, 1, 0, 0] and t.count(parts) == [3, 2, 0, 0]
    assert sum(t.scan(partition=p).count() for p in parts) == 5 and t.partitions(2, most_files=1) == [Partition(0, 2), Partition(1, 2)]


def test_merge_and_cleanup(client, spark):
    t = client.create_table("test", "merging", PEOPLE, config={"inline_row_count_limit": 2})
    for a, b in ((("Alice", 20), ("Bob", 21)), (("Charlie", 22), ("David", 23))):
        t.insert(spark.createDataFrame([a, b], PEOPLE).coalesce(1))
    t.update({"name": F.lit("John")}, "age = 20")
    t.delete("age = 23")
    assert maintenance.merge(t, 2) == 2
    assert (t.inline_row_count(), t.data_file_count()) == (1, 1)
    assert rows(t.df()) == [("Bob", 21), ("Charlie", 22), ("John", 20)]
    assert maintenance.cleanup(t, 0) == []
    assert maintenance.cleanup(t, time.time() + 60)
    assert rows(t.df()) == [("Bob", 21), ("Charlie", 22), ("John", 20)]
    with maintenance.lease(t, "merge") as mine, maintenance.lease(t, "merge") as other:
        assert mine and not other and maintenance.merge(t, 2) == 0
    assert maintenance.rebuild_inline_indexes(t) == 0


def test_bypass_and_formats(client, spark):
    t = client.create_table("test", "bypass", StructType([StructField("id", LongType(), False)]), config={"inline_row_count_limit": 3, "preferred_data_file_format": "v1", "parquet_row_group_size": 2})
    assert t.bypass_insert(spark.range(7).coalesce(1)) == 7
    assert (t.inline_row_count(), t.data_file_count()) == (0, 3)
    assert [f["rows"] for f in t.data_file_records()] == [3, 3, 1]


def test_defaults(client, spark):
    t = client.create_table("test", "defaults", StructType([StructField("name", StringType(), False), StructField("age", IntegerType()), StructField("twice", IntegerType())]), {"age": "24", "twice": "age * 2"})
    t.insert(spark.createDataFrame([("Tom",)], "name string"))
    t.insert(spark.createDataFrame([("Ann", 4)], "name string, age int"))
    assert rows(t.df()) == [("Ann", 4, 8), ("Tom", 24, 48)]
    for kind, text in ((LongType(), "'a'"), (StringType(), "upper('a')"), (IntegerType(), "try_cast('1' as int)"), (IntegerType(), "rand()")):
        with pytest.raises(InvalidInput):
            client.create_table("test", "bad", StructType([StructField("c", kind)]), {"c": text})
    with pytest.raises(InvalidInput):
        client.create_table("test", "bad", StructType([StructField("c", IntegerType(), False)]), {"c": "null"})


def test_conflicts(client, spark):
    client.create_table("test", "racing", PEOPLE).insert(spark.createDataFrame([("a", 1), ("b", 2)], PEOPLE))
    one, two = client.load_table("test", "racing"), client.load_table("test", "racing")
    one.delete("age = 1")
    with pytest.raises(Conflict):
        two.delete("age = 2")
    two = client.load_table("test", "racing")
    one.insert(spark.createDataFrame([("c", 3)], PEOPLE))
    two.insert(spark.createDataFrame([("d", 4)], PEOPLE))  # appends are made again on top
    assert rows(two.df()) == [("b", 2), ("c", 3), ("d", 4)]


def test_ddl_errors(client):
    for schema in (StructType([]), StructType([StructField(ROW_ID, LongType())]), StructType([StructField("a", LongType()), StructField("a", LongType())])):
        with pytest.raises(InvalidInput):
            client.create_table("test", "bad", schema)
    with pytest.raises(NotSupported):
        client.create_table("test", "bad", StructType([StructField("m", MapType(StringType(), StringType()))]))
    client.create_table("test", "twice", PEOPLE)
    with pytest.raises(InvalidInput):
        client.create_table("test", "twice", PEOPLE)
    assert client.create_table("test", "twice", StructType([StructField("x", LongType())]), if_not_exists=True).df().columns == ["name", "age"]
    with pytest.raises(NotFound):
        client.load_table("test", "nothing")
    with pytest.raises(InvalidInput):
        client.create_table("test", "bad", PEOPLE, config={"nothing": 1})


def test_namespaces(client):
    first = client.create_namespace("one")
    assert client.create_namespace("one", if_not_exists=True) == first == client.get_namespace_id("one")
    with pytest.raises(InvalidInput):
        client.create_namespace("one")
    client.rename_namespace("one", "uno")
    assert client.get_namespace_id("one") is None and client.get_namespace_id("uno") == first
    t = client.create_table("uno", "gone", PEOPLE)
    t.drop()
    assert client.tables("uno") == []


def test_types_round_trip(client, spark):
    text = "b boolean, i1 tinyint, i2 smallint, i4 int, i8 bigint, f float, d double, ts timestamp, tn timestamp_ntz, da date, bin binary, s string, l array<int>, fl array<float>, de decimal(38,10), u8 decimal(20,0)"
    df = spark.sql("select true b, 1Y i1, 2S i2, 3 i4, 4L i8, cast(1.5 as float) f, 2.5D d, timestamp'2024-01-01 00:00:00' ts, timestamp_ntz'2024-01-01 00:00:00' tn, date'2024-01-01' da, X'0102' bin, 'x' s, array(1, null) l, array(cast(1 as float)) fl, cast(1.5 as decimal(38,10)) de, cast(18446744073709551615 as decimal(20,0)) u8")
    nulls = spark.createDataFrame([(None,) * 16], text)
    t = client.create_table("test", "types", nulls.schema, config={"inline_row_count_limit": 2})
    t.insert(df)
    t.bypass_insert(nulls)
    assert t.scan(filters=["i4 = 3"]).collect() == df.collect() and t.scan(filters=["b is null"]).collect() == nulls.collect()
    assert isinstance(t.schema["de"].dataType, DecimalType) and t.schema["fl"].dataType == ArrayType(FloatType())


def test_list_filters(client, spark):
    t = client.create_table("test", "lists", StructType([StructField("id", IntegerType()), StructField("vector", ArrayType(FloatType()))]))
    t.insert(spark.createDataFrame([(i, [10.0 * i] * 3) for i in range(1, 5)], t.schema))
    over = "vector > array(cast(20 as float), cast(20 as float), cast(20 as float))"
    assert rows(t.scan(["id"], [over])) == [(3,), (4,)]
    assert t.update({"id": F.lit(10)}, over) == 2
    assert t.delete(over) == 2 and rows(t.scan(["id"])) == [(1,), (2,)]


def test_added_column_after_delete(people):
    people.delete("name = 'Alice'")
    people.add_column(StructField("n", IntegerType()), "7")
    assert rows(people.scan(["name", "n"])) == [("Bob", 7), ("Charlie", 7), ("David", 7)]
    assert people.update({"n": "n + 1"}, "name = 'Bob'") == 1
    assert rows(people.scan(["name", "n"])) == [("Bob", 8), ("Charlie", 7), ("David", 7)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(people):
    """Filters and columns reach the Parquet scan; only files that lost rows are joined with deletes."""
    clean = plan(people.scan(["name"], ["age > 21"]))
    assert "PushedFilters: [IsNotNull" in clean and "GreaterThan" in clean and "Join" not in clean and ROW_ID not in clean
    people.delete("name = 'Bob'")
    dirty = plan(people.scan(["name"], ["age > 21"]))
    assert dirty.count("LeftAnti") == 1 and "BroadcastHashJoin" in dirty and "GreaterThan" in dirty


def test_stale_writers_lose_nothing_silently(client, spark):
    """A handle that is more versions behind than are kept gets a Conflict, or appends on top of the newest."""
    client.create_table("test", "stale", PEOPLE)
    behind, other, now = (client.load_table("test", "stale") for _ in range(3))
    for i in range(25):
        now.insert(spark.createDataFrame([("a", i)], PEOPLE), try_dump=False)
    with pytest.raises(Conflict):
        behind._publish(lambda doc: doc.update(files=[]), rebase=False)
    assert other.insert(spark.createDataFrame([("late", 99)], PEOPLE)) == 1
    t = client.load_table("test", "stale")
    assert t.count() == 26 == t.df().count() and len(t._manifest.versions()) <= 20
    assert t.storage.list(f"{t.path}/manifest")[0][0].endswith(".json")  # no drafts stay


def test_overwrite_is_one_version(people, spark):
    version = people.version
    with pytest.raises(InvalidInput):
        sql.insert_into(people, spark.createDataFrame([("x", "y")], "name string, age string"), mode="overwrite")
    with pytest.raises(Exception, match="name is NULL"):
        sql.insert_into(people, spark.createDataFrame([(None, 1)], "name string, age int"), mode="overwrite")
    assert people.refresh().version == version and people.df().count() == 4
    sql.insert_into(people, spark.createDataFrame([("x", 1)], PEOPLE), mode="overwrite")
    assert people.version == version + 1 and rows(people.df()) == [("x", 1)]


def test_batches_that_repeat(people, spark):
    more = spark.createDataFrame([("x", 1)], PEOPLE)
    assert [people.insert(more, batch=("s", n)) for n in (0, 0, 1, 0)] == [1, 0, 1, 0]
    assert people.insert(more, batch=("other", 0)) == 1 and people.df().count() == 7


def test_lease_is_given_back_by_its_holder_only(people):
    with maintenance.lease(people, "x", seconds=-1) as first:
        with maintenance.lease(people, "x") as second:
            assert first and second
            with maintenance.lease(people, "x") as third:
                assert not third
        with maintenance.lease(people, "x", seconds=-1) as fourth:
            assert fourth
    with maintenance.lease(people, "x") as fifth:
        assert fifth


def test_dump_of_many_lots(client, spark):
    t = client.create_table("test", "lots", StructType([StructField("id", LongType(), False)]), config={"inline_row_count_limit": 10})
    t.insert(spark.range(57), try_dump=False)
    last = {r["id"] for r in t.rows().orderBy(F.col(ROW_ID).desc()).limit(7).collect()}
    assert maintenance.dump(t) == 50
    assert t.inline_row_count() == 7 and all(f["rows"] <= 10 for f in t.data_file_records())
    assert {r[0] for r in t.rows(t._tier("inline")).select("id").collect()} == last and t.df().distinct().count() == 57
    assert t.update({"id": "id + 100"}, "id % 2 = 0") == 29 and t.inline_row_count() <= 7  # as many as fill the tier become files


def test_pages_skip_files_by_count(client, spark):
    t = client.create_table("test", "paged", StructType([StructField("id", LongType(), False)]), config={"inline_row_count_limit": 10})
    for i in range(5):
        t.bypass_insert(spark.range(10 * i, 10 * i + 10).coalesce(1))
    t.delete("id in (3, 15)")
    order = [r["id"] for r in t.rows().orderBy(ROW_ID).collect()]
    for offset, limit in ((0, 3), (9, 1), (12, 20), (40, None), (47, 5), (48, 5)):
        page = t.scan(offset=offset, limit=limit)
        assert [r[0] for r in page.collect()] == order[offset:][:limit]
        assert len(page.inputFiles()) <= (limit or 8) // 9 + 2
    assert len(t._paged(t.doc["files"], 20, 5)[0]) == 1


def test_fetch_reads_the_files_of_the_ids(client, spark):
    t = client.create_table("test", "fetched", StructType([StructField("id", LongType(), False)]))
    for i in range(4):
        t.bypass_insert(spark.range(10 * i, 10 * i + 10).coalesce(1))
    some = spark.createDataFrame(t.rows().where("id in (21, 25)").select(ROW_ID).collect(), f"{ROW_ID} binary")
    assert rows(t.fetch(some)) == [(21,), (25,)] and len(t.fetch(some).inputFiles()) <= 2
    assert t.fetch(some.limit(0)).count() == 0
