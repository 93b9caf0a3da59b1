"""Every query with SQL gives the rows of DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestone import item_queries, model_queries, queries  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_is_its_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    told = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in told.description]
    assert sorted(found.columns) == sorted(columns)
    want = sorted(tuple(map(plain, row)) for row in told.fetchall())
    assert sorted(tuple(map(plain, row)) for row in found.select(*columns).collect()) == want


@pytest.mark.parametrize("name", ["dict_versions", "dict_find"])
def test_of_values_with_one_place_the_smaller_comes_first(spark, duck, name):
    sql = queries.ORACLE_SQL[name]
    told = duck.execute(sql.replace("partition by a.d, a.epoch order by pos)", "partition by a.d, a.epoch order by pos, v)"))  # the SQL itself leaves such ties open
    columns, want = [d[0] for d in told.description], sorted(tuple(map(plain, row)) for row in told.fetchall())
    assert duck.execute(sql[: sql.rindex("held as")].rstrip(" ,\n") + " select count(*) - count(distinct (d, epoch, pos)) from adds").fetchone()[0] > 0
    assert sorted(tuple(map(plain, row)) for row in queries.QUERIES[name](spark, SF).select(*columns).collect()) == want


@pytest.mark.parametrize("name", ["dict_checkpoints", "dict_find", "dict_versions"])
def test_dictionaries_beyond_the_indexes_of_class_files(spark, tmp_path, name):
    month = "case when id < 68000 then 2 when id < 69500 then 6 else 8 end"  # August goes back to May, and June's parts come again
    items = spark.range(72500).selectExpr("id as l_orderkey", "1 as l_linenumber", "if(id < 71000, 70999 - id, 73999 - id) as l_partkey", "3 + id % 5 * 10 as l_suppkey", f"cast(make_date(2000, {month}, 9) as timestamp_ntz) as l_shipdate")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(4000).selectExpr("id as o_orderkey", "13L as o_custkey", "cast(make_date(2000, if(id < 2000, 7, 9), 9) as timestamp_ntz) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    for table in ("lineitem", "orders"):
        duck.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    told = duck.execute(queries.ORACLE_SQL[name])
    columns, want = [d[0] for d in told.description], sorted(tuple(map(plain, row)) for row in told.fetchall())
    assert sorted(tuple(map(plain, row)) for row in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == want
    assert max(int(row[-1]) for row in want if row[-1] != "null") > 65535


def test_empty_and_unknown_matchers():
    from lodestone.operators import matchers

    assert repr(matchers.all_of()) == "()"
    with pytest.raises(ValueError):
        matchers.from_json("class", {"nam": "x"})
    with pytest.raises(ValueError):
        matchers.matches("name", "(?=x)")
    assert repr(~(matchers.classes.flag("public") & matchers.classes.named("A"))) == "!(public & name='A')"


def test_whole_tables_against_brute_force(spark, tmp_path):
    from datetime import datetime, timedelta

    top, day = 420, datetime(2020, 1, 1)
    customers = list(range(1, top + 1))
    orders = [(i, i * 13 % top + 1, "FO"[i % 2], "12"[i // 2 % 2], day + timedelta(days=i % 9)) for i in range(1, 901)]
    items = [(i * 7 % 900, i, i * 11 % 97, day + timedelta(days=i % 9, hours=5)) for i in range(300)]
    for name, rows, kind in (("customer", [(k,) for k in customers], "c_custkey long"), ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"), ("lineitem", items, "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp")):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name, *columns: sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())

    above = {}
    for child in customers:
        seen, level = {}, [(child, "")]
        while level:
            further = sorted((p + str(o), to) for at, p in level if at for o, to in ((0, at // 2), (1, at // 3)))
            level = []
            for path, to in further:
                if to not in seen:
                    seen[to] = path
                    level.append((to, path))
        above[child] = seen
    assert run("closure", "child", "ancestor", "depth", "path") == sorted((c, a, len(p), p) for c in customers for a, p in above[c].items())
    assert run("is_subtype", "child", "ancestor", "is_subtype") == [(c, c % 12, c % 12 == c or c % 12 in above[c]) for c in customers]

    def chain(x):
        return [x, *chain(x // 2)] if x else [0]

    assert run("lca", "a", "b", "common") == [(a, b, next(x for x in chain(a) if x in chain(b))) for a in customers for b in [a * 7 % (top + 1)]]
    methods = {o[1:4] for o in orders}
    want = sorted((c, s, p, a, len(path)) for c, s, p in methods if c % 5 for a, path in above[c].items() if (a, s, p) in methods and a % 5 and a % 7 and (a % 2 == 0 or a % 3 == c % 3))
    assert run("overrides", "owner", "name", "descriptor", "overrides", "depth") == want and any(w[0] > 199 for w in want)

    def end(k):
        for _ in range(500):
            if not 1 <= k <= top:
                return k
            k = k - 6 if k % 101 == 7 else k + k * 31 % 17 + 1
        return None

    got = {r.label: r.end for r in queries.QUERIES["goto_chain"](spark, str(tmp_path)).collect()}
    assert got == {k: end(k) for k in customers}
    want = sorted((o, n, s[0]) for o, n, supplier, at in items for s in orders if supplier % 50 == s[1] % 50 and s[4] <= at < s[4] + timedelta(days=1))
    assert run("range_cover", "l_orderkey", "l_linenumber", "span") == want and want


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "long", "double", "decimal(12,2)"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_spans_of_all_kinds_against_a_cross_join(spark, monkeypatch, kind, zone):
    from pyspark.sql import functions as F

    from lodestone.operators import cfg

    monkeypatch.setattr(cfg, "CHUNK", 7)  # more spans of a key and bin than an array takes
    zone_before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        unit = "minute" if kind.startswith("timestamp") else "day"
        since = "timestamp_ntz'2024-03-10 01:30:00'" if unit == "minute" else "timestamp_ntz'1969-12-01 00:00:00'"  # the night that clocks go forward in; both sides of 1970
        at = lambda n: f"cast({since} + make_dt_interval({f'0, 0, {n}' if unit == 'minute' else n}) as {kind})" if unit == "minute" or kind == "date" else f"cast(({n}) * {'1' if kind == 'long' else '0.37'} - 30 as {kind})"
        spans = spark.range(300).selectExpr("id as span", "if(id % 5 = 0, null, id) as note", "id % 3 as k", f"{at('cast(id % 90 as int)')} as from_", f"{at('cast(id % 90 + (id % 13 - 1) * if(id % 50 = 1, 9, 1) as int)')} as to_")
        points = spark.range(400).selectExpr("id as point", "id % 4 as k", f"if(id % 40 = 39, null, {at('cast(id * 7 % 130 as int)')}) as at")
        got = cfg.interval_cover(points, spans, ["k"], "at", "from_", "to_").select("k", "point", "span", "note")
        want = points.join(spans, "k").where((F.col("at") >= F.col("from_")) & (F.col("at") < F.col("to_"))).select("k", "point", "span", "note")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 300
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone_before)


def test_pairs_of_range_cover_are_no_rows_of_a_join(spark, tmp_path):
    days = "timestamp_ntz'2020-01-01' + make_dt_interval(cast(id % 4 as int)"
    spark.range(4000).selectExpr("id as l_orderkey", "1 as l_linenumber", "id % 2 * 50 as l_suppkey", f"{days}, 5) as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(800).selectExpr("id as o_orderkey", "100L as o_custkey", f"{days}) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = queries.QUERIES["range_cover"](spark, str(tmp_path))
        assert len(found.collect()) == 4000 * 200
        plans, rows = [found._jdf.queryExecution().executedPlan()], []
        while plans:
            plan = plans.pop()
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
            if "Join" in plan.nodeName():
                rows.append(plan.metrics().apply("numOutputRows").value())
        assert rows == [4000]  # each day's orders lie in one array
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_every_registered_query_runs(spark):
    """Those with SQL are compared above; the rest has to run and give a schema that stays."""
    import __spark_entry__

    for name, run in __spark_entry__.queries().items():
        if name not in __spark_entry__.oracle_sql() and not name.startswith(("op", "pipeline")):
            found = run(spark, SF)
            assert found.count() >= 0 and found.columns == run(spark, SF).columns, name


def test_clean_code_is_what_a_loop_makes_of_it(spark):
    rows = [r.asDict() for r in item_queries.code_items(spark, SF).collect()]
    got = {}
    for r in queries.QUERIES["code_clean"](spark, SF).collect():
        got.setdefault(r.user_id, []).append((r.pos, r.event_id, r.target_label))
    for user in {r["user_id"] for r in rows}:
        items = sorted((r for r in rows if r["user_id"] == user), key=lambda r: r["pos"])
        items = [r for r in items if not (r["kind"] == "raw" and r["opcode"] == 0)]
        goto = lambda r: r["kind"] == "branch" and r["opcode"] == 0xA7
        while True:
            pointer = {}
            for i, r in enumerate(items):
                following = next((x for x in items[i:] if x["kind"] != "label"), None)
                if r["kind"] == "label" and following and goto(following):
                    pointer[r["label_id"]] = following["target_label"]
            for r in filter(goto, items):
                seen, at = set(), r["target_label"]
                while at in pointer and at not in seen:
                    seen.add(at)
                    at = pointer[at]
                r["target_label"] = r["target_label"] if at in pointer else at
            idle = []
            for i, r in enumerate(items):
                labels = []
                for x in items[i + 1 :]:
                    if x["kind"] != "label":
                        break
                    labels.append(x["label_id"])
                if goto(r) and r["target_label"] in labels:
                    idle.append(i)
            if not idle:
                break
            items = [r for i, r in enumerate(items) if i not in idle]
        assert sorted(got.get(user, [])) == [(i, r["event_id"], r["target_label"]) for i, r in enumerate(items)], user


def test_long_chains_and_deep_hierarchies_have_no_limit(spark):
    from lodestone.operators import deobfuscate, hierarchy

    n = 300
    edges = spark.createDataFrame([(i, i + 1, 0, "super") for i in range(n)] + [(900, 901, 0, "super"), (901, 900, 0, "super"), (902, 900, 0, "super"), (903, 903, 0, "super")], "child long, parent long, edge_ordinal int, kind string")
    closed = hierarchy.closure(edges)
    assert closed.where(f"child = 0 and ancestor = {n}").first().depth == n and closed.where("child < 900").count() == n * (n + 1) // 2
    assert sorted(r.child for r in hierarchy.cycles(edges).collect()) == [900, 901, 903]
    ring = [(1, i, (i + 1) % 70) for i in range(70)]
    pointers = spark.createDataFrame([(0, i, i + 1) for i in range(n)] + ring + [(1, 100, 3)], "m int, label long, to long")
    got = {(r.m, r.label): r.end for r in deobfuscate.chase(pointers, ["m"], "label", "to").collect()}
    assert got == {(0, i): n for i in range(n)} | {(1, i): None for i in [*range(70), 100]}


def test_greedy_matches_of_runs_with_gaps(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import sequences

    import random

    rng = random.Random(3)
    rows = [(u, i, rng.random() < 0.8) for u in range(30) for i in range(40)]
    for n in (1, 2, 3):
        found = sequences.find_greedy(spark.createDataFrame(rows, "u int, pos long, hit boolean"), [F.col("hit")] * n, ["u"], "pos")
        want = []
        for u in range(30):
            hit, free = [r[2] for r in rows if r[0] == u], 0
            for i in range(40 - n + 1):
                if i >= free and all(hit[i : i + n]):
                    want.append((u, i))
                    free = i + n
        assert sorted((r.u, r.pos) for r in found.collect()) == want
