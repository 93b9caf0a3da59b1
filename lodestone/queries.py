"""Queries that bind the table kernels to the driver's tables, and the same in SQL.

Containers stand for classes, ordered events for code items: a user's events by
(ts, event_id), event types for opcodes; small integers stand for flags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import descriptors, flags, names
from lodestone.operators import cfg, deobfuscate, diff, hierarchy, matchers, reports, rules, sequences, transforms
from lodestone.operators.matchers import Matcher

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with pos: from 0 in each user, by time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "event_id", "event_type", "value", "props")


ORDERED = "e as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_id, event_type, value, props from events)"


# Reports


@query("""select o_orderpriority as name, count(*) as n, count(*) filter (where o_orderstatus = 'F') as n_matching
          from orders group by 1 order by n desc, n_matching desc, name limit 10""")
def top_groups(spark, sf_dir):
    return reports.top_groups(read(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F")


@query("""with o as (select o_custkey, count(*) n_orders from orders group by 1),
          l as (select o_custkey, count(*) n_items from lineitem join orders on l_orderkey = o_orderkey group by 1)
          select c_custkey, coalesce(n_orders, 0) as n_orders, coalesce(n_items, 0) as n_items, c_name
          from customer left join o on c_custkey = o.o_custkey left join l on c_custkey = l.o_custkey
          order by n_orders desc, n_items desc, c_name limit 10""")
def hotspots(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    counted = reports.with_counts(customers, "c_custkey", {"n_orders": (orders, F.count("*")), "n_items": (items, F.count("*"))})
    return reports.top(counted, F.desc("n_orders"), F.desc("n_items"), F.asc("c_name")).select("c_custkey", "n_orders", "n_items", "c_name")


@query(f"""with {ORDERED}, f as (select user_id, event_type, min(pos) pos from e group by 1, 2),
           r as (select *, row_number() over (partition by user_id order by pos) k, count(*) over (partition by user_id) n from f)
           select user_id, max(n) as n_distinct, string_agg(event_type, ',' order by pos) filter (where k <= 3) as sample from r group by 1
           order by n_distinct desc, user_id limit 10""")
def string_hints(spark, sf_dir):
    found = reports.first_distinct(ordered_events(spark, sf_dir), ["user_id"], "event_type", "pos").withColumn("sample", F.array_join("sample", ","))
    return reports.top(found, F.desc("n_distinct"), F.asc("user_id"))


@query("""select p_partkey, p_name from part where regexp_full_match(p_name, '[a-m].*ring') order by p_partkey limit 50""")
def first_n_sample(spark, sf_dir):
    return reports.first_n(read(spark, sf_dir, "part").select("p_partkey", "p_name"), names.full_match(F.col("p_name"), "[a-m].*ring"), "p_partkey", 50)


@query("""select l_returnflag, median(l_quantity) as median, min(l_quantity) as low, max(l_quantity) as high, max(l_quantity) - min(l_quantity) as spread
          from lineitem group by 1""")
def median_spread(spark, sf_dir):
    return reports.spread(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("""select o_orderpriority, cast(floor(median(cast(floor(o_totalprice) as bigint))) as bigint) as median, min(cast(floor(o_totalprice) as bigint)) as low,
          max(cast(floor(o_totalprice) as bigint)) as high, max(cast(floor(o_totalprice) as bigint)) - min(cast(floor(o_totalprice) as bigint)) as spread
          from orders group by 1""")
def median_integer(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderpriority", F.floor("o_totalprice").alias("price"))
    return reports.spread(orders, ["o_orderpriority"], "price", integer=True)


@query("""select l_shipmode_like as stage, round(avg(l_quantity), 6) as mean, count(l_quantity) as n
          from (select l_linestatus || l_returnflag as l_shipmode_like, l_quantity from lineitem) group by 1""")
def stage_averages(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("stage"), "l_quantity")
    return reports.stage_averages(items, "stage", "l_quantity").withColumn("mean", F.round("mean", 6))


@query("""select count(*) as n_parts, count(*) filter (where p_size % 2 = 0) as n_even, count(*) filter (where length(p_name) < 10) as n_short,
          cast(sum(length(p_name)) as bigint) as n_bytes from part""")
def global_counts(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.agg(F.count("*").alias("n_parts"), F.count_if(F.col("p_size") % 2 == 0).alias("n_even"), F.count_if(F.length("p_name") < 10).alias("n_short"), F.sum(F.length("p_name")).alias("n_bytes"))


# Matchers


def matched(spark, sf_dir, matcher: Matcher) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("access_flags"))
    return part.where(matcher.column).select("p_partkey", "name")


@query("""select p_partkey, p_name as name from part where regexp_full_match(p_name, 'red|.*bolt')""")
def match_regex_full(spark, sf_dir):
    return matched(spark, sf_dir, matchers.matches("name", "red|.*bolt"))


@query("""select p_partkey, p_name as name from part where regexp_matches(p_name, 'red|[aeiou]{2}')""")
def match_regex_search(spark, sf_dir):
    return matched(spark, sf_dir, matchers.matches("name", "red|[aeiou]{2}", mode="search"))


@query("""select p_partkey, p_name as name from part where p_size & 17 = 17""")
def match_flags_all(spark, sf_dir):
    return matched(spark, sf_dir, matchers.classes.access_all(0x11))


@query("""select p_partkey, p_name as name from part where p_size & 6 <> 0""")
def match_flags_any(spark, sf_dir):
    return matched(spark, sf_dir, matchers.fields.access_any(0x06))


@query("""select p_partkey, p_name as name from part where p_size & 7 = 0""")
def match_flags_none(spark, sf_dir):
    return matched(spark, sf_dir, matchers.fields.package_private())


@query("""select p_partkey, p_name as name from part
          where (p_size & 1 = 1 and not regexp_matches(p_name, 'blue')) or p_name = 'small ring' or false""")
def match_algebra(spark, sf_dir):
    m = matchers.classes.flag("public") & ~matchers.matches("name", "blue", "search") & matchers.all_of()
    return matched(spark, sf_dir, m | matchers.classes.named("small ring") | matchers.any_of())


@query("""select c_custkey, c_name, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_totalprice > 400000) as gate from customer""")
def member_exists_gate(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    m = Matcher.of((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000), "open and large")
    return transforms.gate_by_member(customers, orders, m, "c_custkey", "gate").select("c_custkey", "c_name", "gate")


# Sequences


@query(f"""with {ORDERED} select user_id, min(pos) as pos from e where event_type = 'purchase' and pos >= 3 group by 1""")
def find_first(spark, sf_dir):
    return sequences.find_first(ordered_events(spark, sf_dir), F.col("event_type") == "purchase", ["user_id"], "pos", 3)


@query("""select user_id, count(*) filter (where event_type = 'error') as n_matches, bool_or(event_type = 'error') as has_match from events group by 1""")
def count_contains(spark, sf_dir):
    return sequences.count_matches(read(spark, sf_dir, "events"), F.col("event_type") == "error", ["user_id"])


@query(f"""with {ORDERED}, h as (select user_id, pos, event_type = 'view' as a,
             lead(event_type) over w in ('click', 'purchase') as b, lead(event_type, 2) over w <> 'error' as c from e window w as (partition by user_id order by pos))
           select user_id, pos from h where a and coalesce(b, false) and coalesce(c, false)""")
def seq_overlap(spark, sf_dir):
    kind = F.col("event_type")
    return sequences.find_all(ordered_events(spark, sf_dir), [kind == "view", kind.isin("click", "purchase"), kind != "error"], ["user_id"], "pos")


GREEDY = f"""with recursive {ORDERED},
  h as (select user_id, pos from (select user_id, pos, event_type in ('view', 'click') as a, lead(event_type) over (partition by user_id order by pos) in ('view', 'click') as b from e) where a and coalesce(b, false)),
  k as (select user_id, pos, row_number() over (partition by user_id order by pos) as i from h),
  g as (select user_id, i, pos, true as taken, pos + 2 as free from k where i = 1
        union all select k.user_id, k.i, k.pos, k.pos >= g.free, case when k.pos >= g.free then k.pos + 2 else g.free end from g join k on k.user_id = g.user_id and k.i = g.i + 1),
  m as (select user_id, pos from g where taken)"""


def _pair():
    return [F.col("event_type").isin("view", "click")] * 2


@query(GREEDY + " select user_id, pos from m")
def seq_greedy(spark, sf_dir):
    return sequences.find_greedy(ordered_events(spark, sf_dir), _pair(), ["user_id"], "pos")


@query(GREEDY + """, r as (select e.user_id, e.pos, case when m.pos is not null then 'pair' else e.event_type end as event_type from e left join m on e.user_id = m.user_id and e.pos = m.pos
         where not exists (select 1 from m x where x.user_id = e.user_id and x.pos + 1 = e.pos))
       select user_id, row_number() over (partition by user_id order by pos) - 1 as pos, event_type from r""")
def seq_replace(spark, sf_dir):
    events = ordered_events(spark, sf_dir).select("user_id", "pos", "event_type")
    return sequences.replace_sequences(events, _pair(), [{"event_type": "pair"}], ["user_id"], "pos")


@query(GREEDY + """, r as (select e.* from e where not exists (select 1 from m x where x.user_id = e.user_id and e.pos between x.pos and x.pos + 1))
       select user_id, row_number() over (partition by user_id order by pos) - 1 as pos, event_type from r""")
def seq_remove(spark, sf_dir):
    events = ordered_events(spark, sf_dir).select("user_id", "pos", "event_type")
    return sequences.replace_sequences(events, _pair(), [], ["user_id"], "pos")


@query(f"""with {ORDERED} select user_id, row_number() over (partition by user_id order by pos) - 1 as pos, event_id from e where event_type <> 'error'""")
def insn_remove(spark, sf_dir):
    return sequences.remove(ordered_events(spark, sf_dir), F.col("event_type") == "error", ["user_id"], "pos").select("user_id", "pos", "event_id")


@query(f"""with {ORDERED}, r as (select user_id, pos, 0 as side, event_type from e union all select user_id, pos, 1, 'receipt' from e where event_type = 'purchase')
           select user_id, row_number() over (partition by user_id order by pos, side) - 1 as pos, event_type from r""")
def insn_insert(spark, sf_dir):
    events = ordered_events(spark, sf_dir).select("user_id", "pos", "event_type")
    return sequences.splice(events, F.col("event_type") == "purchase", [{"event_type": "receipt"}], ["user_id"], "pos", "after")


@query(f"""with {ORDERED}, r as (select user_id, pos, 0 as side, event_type from e union all select user_id, pos, s, t from e, (values (-2, 'open'), (-1, 'check')) as v(s, t) where event_type = 'signup')
           select user_id, row_number() over (partition by user_id order by pos, side) - 1 as pos, event_type from r""")
def insn_insert_before(spark, sf_dir):
    events = ordered_events(spark, sf_dir).select("user_id", "pos", "event_type")
    return sequences.splice(events, F.col("event_type") == "signup", [{"event_type": "open"}, {"event_type": "check"}], ["user_id"], "pos", "before")


@query(f"""with {ORDERED} select user_id, pos, lead(event_id) over w as next_id, first_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by pos rows between current row and unbounded following) as next_error
           from e window w as (partition by user_id order by pos)""")
def next_node(spark, sf_dir):
    events = ordered_events(spark, sf_dir)
    error = F.when(F.col("event_type") == "error", F.col("event_id"))
    return events.select("user_id", "pos", sequences.next_row(F.col("event_id"), ["user_id"], "pos").alias("next_id"), sequences.next_known(error, ["user_id"], "pos").alias("next_error"))


SIZES = "case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 when 'purchase' then 5 else 1 end"


@query(f"""with {ORDERED} select user_id, pos, cast(coalesce(sum({SIZES}) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset from e""")
def running_offset(spark, sf_dir):
    return ordered_events(spark, sf_dir).select("user_id", "pos", sequences.running_sum(F.expr(SIZES), ["user_id"], "pos").alias("byte_offset"))


@query(f"""with {ORDERED}, b as (select *, pos = 0 or coalesce(lag(event_type) over (partition by user_id order by pos) in ('error', 'purchase'), false) as begins from e)
           select user_id, pos, cast(sum(cast(begins as int)) over (partition by user_id order by pos) as bigint) as block from b""")
def block_ids(spark, sf_dir):
    after = F.lag(F.col("event_type").isin("error", "purchase")).over(Window.partitionBy("user_id").orderBy("pos"))
    events = ordered_events(spark, sf_dir).withColumn("begins", (F.col("pos") == 0) | F.coalesce(after, F.lit(False)))
    return events.select("user_id", "pos", sequences.islands(F.col("begins"), ["user_id"], "pos").alias("block"))


@query(f"""with {ORDERED}, d as (select user_id, sum(case when event_type in ('view', 'signup') then 1 else -1 end) over (partition by user_id order by pos) as depth from e)
           select user_id, cast(max(depth) as bigint) as max_depth from d group by 1""")
def stack_depth_max(spark, sf_dir):
    effect = F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(-1)
    depth = ordered_events(spark, sf_dir).withColumn("depth", sequences.running_sum(effect, ["user_id"], "pos", inclusive=True))
    return depth.groupBy("user_id").agg(F.max("depth").alias("max_depth"))


# Transforms


@query("""select event_id, case event_type when 'view' then 'seen' when 'click' then 'pressed' else event_type end as event_type from events""")
def redirect_map(spark, sf_dir):
    mapping = spark.createDataFrame([("view", "seen"), ("click", "pressed")], "event_type string, to_type string")
    return transforms.mapped("event_type", F.broadcast(mapping), ["event_type"], "to_type")(read(spark, sf_dir, "events").select("event_id", "event_type"))


@query("""select p_partkey, case when p_name = 'small ring' then 'ring, small' else p_name end as name from part""")
def replace_string(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("ldc_string"), F.lit("ldc").alias("kind"))
    return transforms.replace_string("small ring", "ring, small")(part).select("p_partkey", F.col("ldc_string").alias("name"))


@query("""select p_partkey, (case when p_size & 1 = 1 then (p_size | 64) & ~2 else p_size end) as access_flags from part""")
def flags_edit(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("access_flags"))
    public = matchers.fields.flag("public")
    return transforms.sequence(transforms.add_flags(64, public), transforms.remove_flags(2, public))(part)


@query("""select p_partkey, array_to_string(case when list_contains(words, 'ring') then words else list_append(words, 'ring') end, ' ') as words
          from (select p_partkey, string_split(p_name, ' ') as words from part)""")
def array_dedup_append(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("interfaces"))
    return transforms.add_interface("ring")(part).select("p_partkey", F.array_join("interfaces", " ").alias("words"))


@query("""with a as (select p_partkey, p_name, p_size, p_name like '%ring' as h1 from part),
          b as (select *, case when h1 then 'loop' else p_name end as n1 from a), c as (select *, n1 = 'loop' and p_size > 10 as h2 from b),
          d as (select *, case when h2 then p_size | 32 else p_size end as s2, p_size & 1 = 1 as h3 from c)
          select 0 as ordinal, count(*) filter (where h1) as matched, count(*) filter (where h1 and p_name <> 'loop') as changed from d
          union all select 1, count(*) filter (where h2), count(*) filter (where h2 and s2 <> p_size) from d
          union all select 2, count(*) filter (where s2 & 32 = 32), count(*) filter (where s2 & 32 = 32) from d""")
def rule_counters(spark, sf_dir):
    from lodestone.plans import patch
    from lodestone.plans.pipeline import Catalog

    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("class_id"), F.col("p_name").alias("name"), F.col("p_size").alias("access_flags"))
    part = part.withColumns({"descriptor": F.when(F.col("access_flags") > 10, "large").otherwise("small"), "has_code": F.lit(False), "major": F.lit(52), "super_name": F.lit(None).cast("string"), "interfaces": F.array().cast("array<string>")})
    plan = patch.load(
        """{"rules": [{"kind": "method", "matcher": {"name_matches": "ring$"}, "action": {"type": "rename", "to": "loop"}},
                      {"kind": "method", "matcher": {"name": "loop", "descriptor": "large"}, "action": {"type": "add-access-flags", "flags": ["synchronized"]}},
                      {"kind": "method", "matcher": {"access_all": ["synchronized"]}, "action": {"type": "remove"}}]}"""
    )
    _, counts = patch.apply(Catalog(part, part, part, part), plan)
    return counts.select("ordinal", F.col("matched_targets").alias("matched"), F.col("changed_targets").alias("changed"))


# Hierarchy

DAG = """g as (select c_custkey as child, c_custkey // 2 as parent, 0 as o from customer where c_custkey <> c_custkey // 2
  union all select c_custkey, c_custkey // 3, 1 from customer where c_custkey <> c_custkey // 3)"""
CLOSED = f"""with recursive {DAG}, walk as (select child, parent as ancestor, 1 as depth, [o] as path from g
  union all select w.child, g.parent, w.depth + 1, list_append(w.path, g.o) from walk w join g on g.child = w.ancestor),
  first as (select child, ancestor, depth, path, row_number() over (partition by child, ancestor order by depth, path) as k from walk),
  closed as (select child, ancestor, depth, path from first where k = 1)"""


def dag(spark, sf_dir) -> DataFrame:
    """Customers with two parents each: half and a third of their key."""
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"))
    half = keys.select("child", F.expr("child div 2").alias("parent"), F.lit(0).alias("edge_ordinal"), F.lit("super").alias("kind"))
    third = keys.select("child", F.expr("child div 3").alias("parent"), F.lit(1).alias("edge_ordinal"), F.lit("interface").alias("kind"))
    return half.unionByName(third)


@query(CLOSED + """ select child, ancestor, depth, array_to_string(path, '') as path, row_number() over (partition by child order by depth, path) - 1 as position from closed""")
def closure(spark, sf_dir):
    closed = hierarchy.visit_order(hierarchy.closure(dag(spark, sf_dir)))
    return closed.select("child", "ancestor", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "").alias("path"), F.col("position").cast("bigint").alias("position"))


@query(CLOSED + """ , p as (select c_custkey as child, c_custkey % 12 as ancestor from customer)
       select p.child, p.ancestor, p.child = p.ancestor or c.child is not null as is_subtype from p left join closed c on p.child = c.child and p.ancestor = c.ancestor""")
def is_subtype(spark, sf_dir):
    pairs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), (F.col("c_custkey") % 12).alias("ancestor"))
    return hierarchy.is_subtype(pairs, hierarchy.closure(dag(spark, sf_dir)))


@query(f"""with recursive {DAG}, up as (select child, parent as ancestor, 1 as depth from g where o = 0 union all select u.child, g.parent, u.depth + 1 from up u join g on g.child = u.ancestor and o = 0),
       w as (select * from up union all select c_custkey, c_custkey, 0 from customer),
       p as (select c_custkey as a, c_custkey * 7 % (select max(c_custkey) + 1 from customer) as b from customer),
       m as (select p.a, p.b, arg_min(x.ancestor, x.depth) as common from p join w x on x.child = p.a join w y on y.child = p.b and y.ancestor = x.ancestor group by 1, 2)
       select a, b, case when a = b then a else coalesce(common, 0) end as common from p left join m using (a, b)""")
def lca(spark, sf_dir):
    """Each customer with one spread over all keys."""
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    pairs = keys.crossJoin(F.broadcast(keys.agg((F.max("a") + 1).alias("n")))).select("a", (F.col("a") * 7 % F.col("n")).alias("b"))  # with one row
    return hierarchy.common_superclass(pairs, hierarchy.super_lifting(dag(spark, sf_dir).where("child <> parent")), F.lit(0).cast("bigint")).select("a", "b", "common")


@query(CLOSED + """, m as (select distinct o_custkey as owner, o_orderstatus as name, o_orderpriority as descriptor from orders),
       f as (select *, (owner % 5 = 0) as hidden, (owner % 7 = 0) as final, (owner % 2 = 0) as open, owner % 3 as package from m)
       select c.child as owner, a.name, a.descriptor, c.ancestor as overrides, c.depth from closed c join f a on a.owner = c.child and not a.hidden
       join f b on b.owner = c.ancestor and b.name = a.name and b.descriptor = a.descriptor and not b.hidden and not b.final and (b.open or b.package = a.package)""")
def overrides(spark, sf_dir):
    return hierarchy.overridden(order_methods(read(spark, sf_dir, "orders")), hierarchy.closure(dag(spark, sf_dir)))


def order_methods(orders: DataFrame) -> DataFrame:
    """Methods of customers, named by the status and priority of their orders."""
    named = orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("descriptor")).distinct()
    owner = F.col("owner")
    bit = lambda test, value: F.when(test, F.lit(value)).otherwise(0)
    return named.withColumns({"access_flags": bit(owner % 5 == 0, 2) + bit(owner % 7 == 0, 16) + bit(owner % 2 == 0, 1), "package": owner % 3})


#: Most keys point onward, some back; chains end beyond the last key or run in a circle.
POINTER = "case when c_custkey % 101 = 7 then c_custkey - 6 else c_custkey + c_custkey * 31 % 17 + 1 end"


@query(f"""with recursive p as (select c_custkey as k, {POINTER} as n from customer),
       w as (select k, n as e, 1 as steps from p union all select w.k, p.n, steps + 1 from w join p on p.k = w.e where steps <= (select count(*) from customer)),
       l as (select k, arg_max(e, steps) as e, max(steps) as steps from w group by 1)
       select k as label, case when steps <= (select count(*) from customer) then e end as "end" from l""")
def goto_chain(spark, sf_dir):
    pointers = read(spark, sf_dir, "customer").select(F.lit(0).alias("m"), F.col("c_custkey").alias("label"), F.expr(POINTER).alias("to"))
    return deobfuscate.chase(pointers, ["m"], "label", "to").select("label", "end")


@query(f"""with recursive p as (select c_custkey as k, {POINTER} as n from customer),
       w as (select k, n as e, 1 as steps from p union all select w.k, p.n, steps + 1 from w join p on p.k = w.e where w.e <> w.k and steps <= (select count(*) from customer))
       select distinct k as child from w where k = e""")
def hierarchy_cycles(spark, sf_dir):
    return hierarchy.cycles(pointers(spark, sf_dir)).select("child")


def pointers(spark, sf_dir) -> DataFrame:
    """Customers with one parent each, by POINTER."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), F.expr(POINTER).alias("parent"), F.lit(0).alias("edge_ordinal"), F.lit("super").alias("kind"))


# Joins, dictionaries, duplicates


@query("""select l_orderkey, l_linenumber, o_orderkey as span from lineitem join orders on l_suppkey % 50 = o_custkey % 50 and l_shipdate >= o_orderdate and l_shipdate < o_orderdate + interval 1 day""")
def range_cover(spark, sf_dir):
    return covered(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"))


def covered(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Line items with the orders of their group on whose day they were shipped."""
    items = lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_suppkey") % 50).alias("k"))
    spans = orders.select(F.col("o_orderkey").alias("span"), F.col("o_orderdate").alias("from_"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("to_"), (F.col("o_custkey") % 50).alias("k"))
    return cfg.interval_cover(items, spans, ["k"], "l_shipdate", "from_", "to_").select("l_orderkey", "l_linenumber", "span")


@query("""select p_brand, row_number() over (order by first_key, p_brand) - 1 as code from (select p_brand, min(p_partkey) as first_key from part group by 1)""")
def dict_encode(spark, sf_dir):
    return reports.dictionary(read(spark, sf_dir, "part"), "p_brand", "p_partkey").withColumn("code", F.col("code").cast("bigint"))


@query("""select r_name, count(*) as n_items, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents from lineitem join orders on l_orderkey = o_orderkey
          join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""")
def fk_resolve(spark, sf_dir):
    t = lambda name: read(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n_items"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))


@query("""select o_orderkey, copy from (select o_orderkey, row_number() over (partition by o_custkey, o_orderstatus, o_orderpriority order by o_orderkey) as copy from orders) where copy > 1""")
def dup_members(spark, sf_dir):
    copies = reports.extra_copies(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderkey")
    return copies.select("o_orderkey", F.col("copy").cast("bigint").alias("copy"))


@query("""select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2 having count(*) >= 3""")
def multiplicity(spark, sf_dir):
    return reports.multiplicity(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], 3)


@query("""select l_orderkey, l_linenumber from lineitem where l_partkey % 7 = 0""")
def dangling_refs(spark, sf_dir):
    kept = read(spark, sf_dir, "part").where("p_partkey % 7 != 0")
    return reports.dangling(read(spark, sf_dir, "lineitem"), "l_partkey", kept, "p_partkey").select("l_orderkey", "l_linenumber")


@query("""select 'ERROR' as severity, 'Quantity' as category, 'quantity above 49' as message, l_orderkey as id from lineitem where l_quantity > 49
          union all select 'WARNING', 'Discount', 'discount of ' || l_linestatus || ' above 9 %', l_orderkey from lineitem where l_discount > 0.09
          union all select 'ERROR', 'Flag', 'returned and open', l_orderkey from lineitem where l_returnflag = 'R' and l_linestatus = 'O'
          union all select 'ERROR', 'Price', 'total below 2000', o_orderkey from orders where o_totalprice < 2000
          union all select 'INFO', 'Status', 'pending', o_orderkey from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT'
          union all select 'ERROR', 'Reference', 'unknown customer', o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 11 <> 0)""")
def violations(spark, sf_dir):
    items = [
        rules.Rule("Quantity", "quantity above 49", F.col("l_quantity") > 49),
        rules.Rule("Discount", F.concat(F.lit("discount of "), "l_linestatus", F.lit(" above 9 %")), F.col("l_discount") > 0.09, "WARNING"),
        rules.Rule("Flag", "returned and open", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")),
    ]
    orders = [
        rules.Rule("Price", "total below 2000", F.col("o_totalprice") < 2000),
        rules.Rule("Status", "pending", (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), "INFO"),
    ]
    known = read(spark, sf_dir, "customer").where("c_custkey % 11 != 0")
    stray = reports.dangling(read(spark, sf_dir, "orders"), "o_custkey", known, "c_custkey")
    found = [
        rules.violations(read(spark, sf_dir, "lineitem"), items, {"id": "l_orderkey"}),
        rules.violations(read(spark, sf_dir, "orders"), orders, {"id": "o_orderkey"}),
        rules.violations(stray, [rules.Rule("Reference", "unknown customer", F.lit(True))], {"id": "o_orderkey"}),
    ]
    return rules.gather(*found, columns=["id"])


# Diffs


@query("""with a as (select p_partkey, p_name, p_size from part where p_partkey % 13 <> 0), b as (select p_partkey, case when p_partkey % 5 = 0 then p_name || '!' else p_name end as p_name,
          case when p_partkey % 6 = 0 then p_size + 1 else p_size end as p_size from part where p_partkey % 17 <> 0)
          select coalesce(a.p_partkey, b.p_partkey) as p_partkey, case when b.p_partkey is null then 'missing' else 'extra' end as change, null as "column", null as old, null as new
          from a full join b on a.p_partkey = b.p_partkey where a.p_partkey is null or b.p_partkey is null
          union all select a.p_partkey, 'changed', 'p_name', a.p_name, b.p_name from a join b using (p_partkey) where a.p_name is distinct from b.p_name
          union all select a.p_partkey, 'changed', 'p_size', a.p_size::varchar, b.p_size::varchar from a join b using (p_partkey) where a.p_size is distinct from b.p_size""")
def snapshot_diff(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    key = F.col("p_partkey")
    before = part.where(key % 13 != 0)
    after = part.where(key % 17 != 0).withColumns({"p_name": F.when(key % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), "p_size": F.when(key % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))})
    return diff.snapshot_diff(before, after, ["p_partkey"], ["p_name", "p_size"])


@query(f"""with {ORDERED}, b as (select user_id, pos, case when event_id % 9 = 0 then 'view' when event_id % 10 = 0 then 'tap' else event_type end as v from e where not (user_id % 10 = 0 and pos = 0)),
          n as (select coalesce(x.user_id, y.user_id) as user_id, coalesce(x.n, 0) as a, coalesce(y.n, 0) as b from (select user_id, count(*) n from e group by 1) x full join (select user_id, count(*) n from b group by 1) y on x.user_id = y.user_id)
          select user_id, -1 as pos, 'ERROR' as severity, a::varchar as old, b::varchar as new from n where a <> b
          union all select e.user_id, e.pos, case when e.event_type in ('click', 'tap') and b.v in ('click', 'tap') then 'WARNING' when left(e.event_type, 1) = left(b.v, 1) then 'INFO' else 'ERROR' end, e.event_type, b.v
          from e join b on e.user_id = b.user_id and e.pos = b.pos join n on n.user_id = e.user_id and n.a = n.b where e.event_type <> b.v""")
def sequence_diff(spark, sf_dir):
    before = ordered_events(spark, sf_dir)
    value = F.when(F.col("event_id") % 9 == 0, "view").when(F.col("event_id") % 10 == 0, "tap").otherwise(F.col("event_type"))
    after = before.where(~((F.col("user_id") % 10 == 0) & (F.col("pos") == 0))).withColumn("event_type", value)
    first = lambda df: df.withColumn("symbol", F.left("event_type", F.lit(1)))
    same = spark.createDataFrame([("click", "tap")], "a string, b string")
    return diff.sequence_diff(first(before), first(after), ["user_id"], "pos", "event_type", "symbol", F.broadcast(same))


# Scalar functions

DESCRIPTOR = "'(' || repeat('J', l_linenumber % 3) || repeat('[I', l_linenumber % 2) || 'Ljava/lang/String;D)' || case when l_linenumber % 2 = 0 then 'V' else '[Ljava/util/List;' end"


@query(f"""select l_orderkey, l_linenumber, 2 * (l_linenumber % 3) + (l_linenumber % 2) + 3 as slots, (l_linenumber % 3) + (l_linenumber % 2) + 2 as n_parameters,
           case when l_linenumber % 2 = 0 then 'V' else '[Ljava/util/List;' end as returns, true as valid, l_linenumber % 2 as dims from lineitem""")
def descriptor_slots(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(DESCRIPTOR).alias("d"))
    d = F.col("d")
    returns = descriptors.return_type(d)
    return items.select("l_orderkey", "l_linenumber", descriptors.parameter_slots(d).alias("slots"), F.size(descriptors.parameters(d)).alias("n_parameters"), returns.alias("returns"), descriptors.is_method_descriptor(d).alias("valid"), descriptors.dimensions(returns).alias("dims"))


@query("""select page_id, case when contains(url, '/') then regexp_extract(url, '^(.*)/[^/]*$', 1) else '<root>' end as package, string_split(url, '/')[-1] as simple,
          regexp_full_match(string_split(url, '/')[-1], '[a-z]{1,2}') as suspicious from pages""")
def name_split(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", names.report_package(url).alias("package"), names.simple_name(url).alias("simple"), names.is_suspicious(names.simple_name(url)).alias("suspicious"))


@query("""select doc_id, line, length(part) >= 4 and length(regexp_replace(part, '[^\\p{L}]', '', 'g')) >= 3 and not regexp_matches(part, '\\p{Cc}') as readable
          from (select doc_id, unnest(string_split(text, chr(10))) as part, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents)""")
def readable(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "part"))
    return lines.select("doc_id", F.col("line").cast("bigint").alias("line"), names.is_readable(F.col("part")).alias("readable"))


@query("""select doc_id, cast(strlen(text) + 2 * (length(text) - length(regexp_replace(text, '[\\x{10000}-\\x{10FFFF}]', '', 'g'))) as bigint) as n_bytes from documents""")
def mutf8_len(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", names.modified_utf8_length(F.col("text")).cast("bigint").alias("n_bytes"))


@query("""select event_id, cast(props ->> '$.k' as integer) as k from events where cast(props ->> '$.k' as integer) > 50""")
def json_filter(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return events.where("k > 50")


@query("""select p_partkey, p_size, array_to_string(list_filter(['PUBLIC', 'PRIVATE', 'PROTECTED', 'STATIC', 'FINAL'], lambda x: p_size & (case x when 'PUBLIC' then 1 when 'PRIVATE' then 2 when 'PROTECTED' then 4 when 'STATIC' then 8 else 16 end) <> 0), ',') as flags from part""")
def flag_names(spark, sf_dir):
    known = {k: v for k, v in flags.FIELD_FLAGS.items() if v <= 16}
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", F.array_join(flags.names(F.col("p_size"), known), ",").alias("flags"))
