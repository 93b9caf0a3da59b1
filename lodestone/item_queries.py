"""Queries that bind code items, matchers, pipelines, clean-up and structural checks to the driver's tables, with SQL.

The events of a user are the code items of a method: sign-ups are labels, clicks
branches, errors switches, purchases returns, views plain instructions.  Parts
are classes, orders are the methods of their customers.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import descriptors, names, opcodes
from lodestone.operators import cfg, deobfuscate, hierarchy, matchers, reports, transforms
from lodestone.plans import debug, patch, verify
from lodestone.plans.pipeline import Catalog, Pipeline
from lodestone.queries import ORDERED, ordered_events, query, read
from lodestone.sources import archives

BY = ["user_id"]

# Code items

ITEMS = ORDERED + """,
  t as (select user_id, pos, event_id, case event_type when 'signup' then 'label' when 'click' then 'branch' when 'error' then 'table_switch' else 'raw' end as kind,
    case event_type when 'signup' then null when 'click' then case when event_id % 2 = 0 then 167 else 153 end when 'error' then 170 when 'purchase' then 177 else case when event_id % 3 = 0 then 0 else 87 end end as opcode from e),
  b as (select *, min(case when kind = 'label' then pos end) over (partition by user_id) as low, max(case when kind = 'label' then pos end) over (partition by user_id) as high from t),
  items as (select user_id, pos, event_id, kind, opcode, case when kind = 'label' then pos end as label_id, case when kind = 'branch' then case when event_id % 4 < 2 then low else high end end as target_label,
    case when kind = 'table_switch' then low end as switch_default, case when kind = 'table_switch' then [high, low] end as switch_labels, low, high from b)"""


def code_items(spark, sf_dir) -> DataFrame:
    kind = "case event_type when 'signup' then 'label' when 'click' then 'branch' when 'error' then 'table_switch' else 'raw' end"
    opcode = "case event_type when 'signup' then null when 'click' then if(event_id % 2 = 0, 167, 153) when 'error' then 170 when 'purchase' then 177 else if(event_id % 3 = 0, 0, 87) end"
    items = ordered_events(spark, sf_dir).selectExpr("user_id", "pos", "event_id", f"{kind} as kind", f"{opcode} as opcode")
    ends = items.where("kind = 'label'").groupBy("user_id").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    return items.join(ends, "user_id", "left").selectExpr(
        "user_id", "pos", "event_id", "kind", "opcode", "if(kind = 'label', pos, null) as label_id", "if(kind = 'branch', if(event_id % 4 < 2, low, high), null) as target_label",
        "if(kind = 'table_switch', low, null) as switch_default", "if(kind = 'table_switch', array(high, low), null) as switch_labels", "low", "high",
    )


NODES = ITEMS + """, nodes as (select *, row_number() over (partition by user_id order by pos) - 1 as node from items where kind <> 'label'),
  counted as (select *, sum(case when kind <> 'label' then 1 else 0 end) over (partition by user_id order by pos) as n, sum(case when kind <> 'label' then 1 else 0 end) over (partition by user_id) as total from items),
  labels as (select user_id, label_id as label, case when n < total then n end as node from counted where kind = 'label')"""
EDGES = NODES + """, aims as (select user_id, node as src, target_label as label, 0 as edge_ordinal from nodes where kind = 'branch'
    union all select user_id, node, low, 0 from nodes where kind = 'table_switch' union all select user_id, node, high, 1 from nodes where kind = 'table_switch' and high <> low),
  told as (select a.user_id, a.src, l.node as dst, min(edge_ordinal) as edge_ordinal from aims a join labels l on a.user_id = l.user_id and a.label = l.label group by 1, 2, 3),
  onward as (select user_id, node as src, lead(node) over (partition by user_id order by node) as dst, opcode, kind from nodes),
  edges as (select user_id, src, dst, edge_ordinal from told union all
    select user_id, src, dst, 1048576 from onward o where dst is not null and kind <> 'table_switch' and opcode not in (167, 177) and not exists (select 1 from told t where t.user_id = o.user_id and t.src = o.src and t.dst = o.dst))"""


@query(f"with {NODES} select user_id, pos, node from nodes")
def code_nodes(spark, sf_dir):
    return cfg.nodes(code_items(spark, sf_dir), BY, "pos").select("user_id", "pos", "node")


@query(f"with {NODES} select user_id, label, cast(node as integer) as node from labels")
def code_labels(spark, sf_dir):
    return cfg.label_nodes(code_items(spark, sf_dir), BY, "pos")


@query(f"with {ITEMS} select user_id, pos, not (kind = 'table_switch' or coalesce(opcode in (167, 177), false)) as falls from items")
def code_falls_through(spark, sf_dir):
    return code_items(spark, sf_dir).select("user_id", "pos", cfg.falls_through().alias("falls"))


@query(f"with {EDGES} select user_id, src, cast(dst as integer) as dst, edge_ordinal from edges")
def code_edges(spark, sf_dir):
    return cfg.jump_edges(code_items(spark, sf_dir), BY, "pos")


def _handlers(items: DataFrame) -> DataFrame:
    """From a user's first label to the last one, the last one handles all."""
    return items.where("kind = 'label' and pos = low").select("user_id", F.lit(0).alias("handler_ordinal"), F.col("low").alias("start_label"), F.col("high").alias("end_label"), F.col("high").alias("handler_label"), F.lit("any").alias("catch_type"))


HANDLED = EDGES + """, spans as (select distinct i.user_id, s.node as first, h.node as last from items i join labels s on s.user_id = i.user_id and s.label = i.low join labels h on h.user_id = i.user_id and h.label = i.high),
  caught as (select n.user_id, n.node as src, s.last as dst from nodes n join spans s on s.user_id = n.user_id and n.node >= s.first and (s.last is null or n.node < s.last))"""


@query(f"with {HANDLED} select user_id, src, cast(dst as integer) as dst, 'any' as catch_type, 0 as handler_ordinal from caught")
def code_handler_edges(spark, sf_dir):
    items = code_items(spark, sf_dir)
    return cfg.handler_edges(items, _handlers(items), BY, "pos")


@query(f"""with {HANDLED}, aimed as (select user_id, dst from told union select user_id, dst from caught),
  marked as (select n.user_id, n.node, n.node = 0 or a.dst is not null or coalesce(lag(n.kind <> 'raw' or n.opcode = 177) over (partition by n.user_id order by n.node), false) as is_block_start
    from nodes n left join aimed a on a.user_id = n.user_id and a.dst = n.node)
  select user_id, node, is_block_start, cast(sum(cast(is_block_start as integer)) over (partition by user_id order by node) as bigint) as block from marked""")
def code_blocks(spark, sf_dir):
    items = code_items(spark, sf_dir)
    return cfg.blocks(items, cfg.jump_edges(items, BY, "pos"), BY, "pos", cfg.handler_edges(items, _handlers(items), BY, "pos"))


# Clean-up


@query(f"with {ITEMS} select user_id, row_number() over (partition by user_id order by pos) - 1 as pos, event_id from items where not (kind = 'raw' and opcode = 0)")
def code_without_nops(spark, sf_dir):
    return deobfuscate.remove_nops(code_items(spark, sf_dir), BY, "pos").select("user_id", "pos", "event_id")


@query(f"""with {ITEMS}, runs as (select *, sum(case when kind <> 'label' then 1 else 0 end) over (partition by user_id order by pos) as run from items)
  select g.user_id, g.pos from runs g where g.kind = 'branch' and g.opcode = 167 and exists (select 1 from runs l where l.user_id = g.user_id and l.run = g.run and l.kind = 'label' and l.label_id = g.target_label)""")
def code_idle_gotos(spark, sf_dir):
    return deobfuscate.idle_gotos(code_items(spark, sf_dir), BY, "pos")


GOTOS = ITEMS + """, named as (select *, sum(case when kind <> 'label' then 1 else 0 end) over (partition by user_id order by pos) + case when kind = 'label' then 1 else 0 end as run from items),
  pointers as (select l.user_id, l.label_id as label, g.target_label as "to" from named l join named g on g.user_id = l.user_id and g.run = l.run and g.kind = 'branch' and g.opcode = 167 where l.kind = 'label')"""


@query(f"with {GOTOS} select user_id, label, \"to\" from pointers")
def code_goto_pointers(spark, sf_dir):
    return deobfuscate.goto_pointers(code_items(spark, sf_dir), BY, "pos")


CHASED = GOTOS + """, walk as (select user_id, label, "to" as hop, 1 as steps from pointers union all select w.user_id, w.label, p."to", steps + 1 from walk w join pointers p on p.user_id = w.user_id and p.label = w.hop where steps < 9),
  ends as (select user_id, label, arg_max(hop, steps) as hop from walk group by 1, 2 having max(steps) < 9)"""


@query(f"""with recursive {CHASED} select i.user_id, i.pos, case when i.kind = 'branch' and i.opcode = 167 then coalesce(e.hop, i.target_label) else i.target_label end as target_label
  from items i left join ends e on e.user_id = i.user_id and e.label = i.target_label""")
def code_collapsed_gotos(spark, sf_dir):
    """A user's gotos aim at two labels, so chains are short and circles are of one or two."""
    return deobfuscate.collapse_gotos(code_items(spark, sf_dir), BY, "pos").select("user_id", "pos", "target_label")


@query()
def code_clean(spark, sf_dir):
    """Iterates until nothing changes, so it has no SQL; tested against a loop in Python."""
    return deobfuscate.clean(code_items(spark, sf_dir), BY, "pos").select("user_id", "pos", "event_id", "target_label")


@query(f"""with {ITEMS}, m as (select *, user_id * 100 + pos // 4 as method from items), moving as (select distinct method from m where kind <> 'raw')
  select method, row_number() over (partition by method order by pos) - 1 as pos, event_id from m where method in (select method from moving) or opcode <> 0""")
def code_straight_nops(spark, sf_dir):
    """Every four items are a method here, so some have no jumps."""
    items = code_items(spark, sf_dir).withColumn("method", F.expr("user_id * 100 + pos div 4")).drop("user_id")
    found = deobfuscate.remove_nops_of_straight_code(items, ["method"], "pos").select("method", "pos", "event_id")
    return found.withColumn("pos", F.expr("row_number() over (partition by method order by pos) - 1").cast("bigint"))


# Matchers of code items

CALLS = """c as (select event_id, ['label', 'raw', 'field', 'method', 'interface_method', 'invoke_dynamic', 'ldc', 'var', 'type', 'branch'][1 + event_id % 10] as kind, cast(18 + event_id * 7 % 180 as integer) as opcode,
  'own/C' || (k % 5) as owner, 'm' || (k % 7) as name, case when k % 2 = 0 then '(I)V' else '()J' end as descriptor, k % 4 as slot, 's' || (k % 6) as ldc_string from (select event_id, cast(props ->> '$.k' as integer) as k from events))"""
_I = matchers.insns
INSNS = {
    "insn_any": (lambda: _I.any(), "true"),
    "insn_opcode": (lambda: _I.opcode(0x99), "opcode = 153 and kind <> 'label'"),
    "insn_opcode_any": (lambda: _I.opcode_any([0x12, 0x60]), "opcode in (18, 19, 20, 96) and kind <> 'label'"),
    "insn_is_field": (lambda: _I.is_field_access(), "kind = 'field'"),
    "insn_is_call": (lambda: _I.is_method_call(), "kind in ('method', 'interface_method', 'invoke_dynamic')"),
    "insn_is_return": (lambda: _I.is_return(), "kind = 'raw' and opcode between 172 and 177"),
    "insn_is_branch": (lambda: _I.is_branch(), "kind = 'branch'"),
    "insn_is_label": (lambda: _I.is_label(), "kind = 'label'"),
    "insn_is_ldc": (lambda: _I.is_ldc(), "kind = 'ldc'"),
    "insn_is_var": (lambda: _I.is_var(), "kind = 'var'"),
    "insn_field_parts": (lambda: _I.field("own/C1", None, "()J"), "kind = 'field' and owner = 'own/C1' and descriptor = '()J'"),
    "insn_method_parts": (lambda: _I.method("own/C2", "m3"), "kind in ('method', 'interface_method') and owner = 'own/C2' and name = 'm3'"),
    "insn_method_named": (lambda: _I.method(name="m4"), "kind in ('method', 'interface_method', 'invoke_dynamic') and name = 'm4'"),
    "insn_type": (lambda: _I.type_descriptor("(I)V"), "kind = 'type' and descriptor = '(I)V'"),
    "insn_ldc_string": (lambda: _I.ldc_string("s2"), "kind = 'ldc' and ldc_string = 's2'"),
    "insn_var_slot": (lambda: _I.var_slot(3), "kind = 'var' and slot = 3"),
    "insn_field_owner": (lambda: _I.field_owner_matches("own/C[0-2]"), "kind = 'field' and owner in ('own/C0', 'own/C1', 'own/C2')"),
    "insn_method_owner": (lambda: _I.method_owner_matches("own/C[34]"), "kind in ('method', 'interface_method') and owner in ('own/C3', 'own/C4')"),
    "insn_method_name": (lambda: _I.method_name_matches("m[05]"), "kind in ('method', 'interface_method', 'invoke_dynamic') and name in ('m0', 'm5')"),
    "insn_algebra": (lambda: ~(_I.is_var() | _I.is_ldc()) & matchers.not_(_I.is_label()), "kind not in ('var', 'ldc', 'label')"),
}


def calls(spark, sf_dir) -> DataFrame:
    kinds = "array('label', 'raw', 'field', 'method', 'interface_method', 'invoke_dynamic', 'ldc', 'var', 'type', 'branch')[event_id % 10]"
    events = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return events.selectExpr(
        "event_id", f"{kinds} as kind", "cast(18 + event_id * 7 % 180 as int) as opcode", "concat('own/C', k % 5) as owner", "concat('m', k % 7) as name", "if(k % 2 = 0, '(I)V', '()J') as descriptor",
        "k % 4 as slot", "concat('s', k % 6) as ldc_string",
    )


def _named(name: str, sql: str | None, run) -> None:
    run.__name__ = name
    query(sql)(run)


for _name, (_matcher, _sql) in INSNS.items():
    _named(_name, f"with {CALLS} select event_id, kind from c where {_sql}", lambda spark, sf_dir, m=_matcher: calls(spark, sf_dir).where(m().column).select("event_id", "kind"))

# Matchers of classes and members

_C, _F, _M = matchers.classes, matchers.fields, matchers.methods
MEMBERS = """m as (select p_partkey, case p_partkey % 10 when 0 then '<init>' when 1 then '<clinit>' else p_name end as name, p_size as access_flags, p_brand as super_name, string_split(p_name, ' ') as interfaces,
  p_size as major, case when p_size % 2 = 0 then '(IJ)V' else '()[J' end as descriptor, p_partkey % 3 = 0 as has_code from part)"""
CLASS_MATCHERS = {
    "match_any": (lambda: matchers.anything(), "true"),
    "match_extends": (lambda: _C.extends("Brand#11"), "super_name = 'Brand#11'"),
    "match_implements": (lambda: _C.implements("ring"), "list_contains(interfaces, 'ring')"),
    "match_version": (lambda: _C.version(21), "major = 21"),
    "match_version_at_least": (lambda: _C.version_at_least(40), "major >= 40"),
    "match_version_below": (lambda: _C.version_below(9), "major < 9"),
    "match_class_package": (lambda: _C.package_private(), "access_flags & 1 = 0"),
    "match_descriptor": (lambda: _M.descriptor("(IJ)V"), "descriptor = '(IJ)V'"),
    "match_descriptor_pattern": (lambda: _F.descriptor_matches(r"\(\).*"), "descriptor = '()[J'"),
    "match_has_code": (lambda: _M.has_code(), "has_code"),
    "match_constructor": (lambda: _M.is_constructor(), "name = '<init>'"),
    "match_static_initializer": (lambda: _M.is_static_initializer(), "name = '<clinit>'"),
    "match_returns": (lambda: _M.returns("[J"), "descriptor = '()[J'"),
    "match_method_flag": (lambda: _M.flag("synchronized"), "access_flags & 32 = 32"),
    "match_not": (lambda: matchers.not_(_M.has_code() | _M.named("red bolt")), "not (has_code or name = 'red bolt')"),
    "match_json_class": (lambda: matchers.from_json("class", {"extends": "Brand#7", "version_at_least": 10, "access_any": ["public", "final"]}), "super_name = 'Brand#7' and major >= 10 and access_flags & 17 <> 0"),
    "match_json_method": (lambda: matchers.from_json("method", {"has_code": False, "name_matches": "ring$", "package_private": True}), "not has_code and name like '%ring' and access_flags & 7 = 0"),
}


def members(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey", "case p_partkey % 10 when 0 then '<init>' when 1 then '<clinit>' else p_name end as name", "p_size as access_flags", "p_brand as super_name", "split(p_name, ' ') as interfaces", "p_size as major",
        "if(p_size % 2 = 0, '(IJ)V', '()[J') as descriptor", "p_partkey % 3 = 0 as has_code",
    )


for _name, (_matcher, _sql) in CLASS_MATCHERS.items():
    _named(_name, f"with {MEMBERS} select p_partkey, name from m where {_sql}", lambda spark, sf_dir, m=_matcher: members(spark, sf_dir).where(m().column).select("p_partkey", "name"))


# Edits and pipelines


@query(f"with {MEMBERS} select p_partkey, case when major > 25 then 'Base' else super_name end as super_name from m")
def edit_super_class(spark, sf_dir):
    return transforms.set_super_class("Base", _C.version_at_least(26))(members(spark, sf_dir)).select("p_partkey", "super_name")


@query(f"with {MEMBERS} select p_partkey, array_to_string(list_filter(interfaces, lambda x: x <> 'ring'), ' ') as interfaces from m")
def edit_remove_interface(spark, sf_dir):
    return transforms.remove_interface("ring")(members(spark, sf_dir)).select("p_partkey", F.array_join("interfaces", " ").alias("interfaces"))


@query(f"with {MEMBERS} select p_partkey, access_flags from m where not has_code")
def edit_drop_methods(spark, sf_dir):
    return transforms.drop_rows(_M.has_code())(members(spark, sf_dir)).select("p_partkey", "access_flags")


@query(f"with {MEMBERS} select p_partkey, case when has_code then 'kept' else name end as name, case when has_code then 9 else access_flags end as access_flags from m")
def edit_rename_and_set(spark, sf_dir):
    return transforms.sequence(transforms.set_flags(9, _M.has_code()), transforms.rename("kept", _M.has_code()))(members(spark, sf_dir)).select("p_partkey", "name", "access_flags")


@query(f"with {CALLS}, h as (select *, kind in ('method', 'interface_method') and owner = 'own/C2' as hit from c) select event_id, case when hit then 'own/New' else owner end as owner, case when hit then 'made' else name end as name from h")
def edit_redirect_calls(spark, sf_dir):
    return transforms.redirect_calls(_I.method("own/C2"), "own/New", "made")(calls(spark, sf_dir)).select("event_id", "owner", "name")


def catalog(spark, sf_dir) -> Catalog:
    """Customers as classes, orders as their methods and fields, line items as code."""
    t = lambda name: read(spark, sf_dir, name)
    classes = t("customer").selectExpr("c_custkey as class_id", "c_name as name", "c_mktsegment as super_name", "c_nationkey as access_flags", "array(c_mktsegment) as interfaces", "c_nationkey + 40 as major")
    methods = t("orders").selectExpr("o_custkey as class_id", "o_orderkey as ordinal", "o_orderstatus as name", "o_orderpriority as descriptor", "cast(o_orderkey % 64 as int) as access_flags", "o_orderkey % 3 = 0 as has_code")
    items = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "o_custkey as class_id", "l_orderkey as method_ordinal", "l_linenumber as item_ordinal", "if(l_returnflag = 'R', 'method', 'raw') as kind", "cast(l_quantity as int) as opcode", "l_linestatus as owner", "l_returnflag as name", "'()V' as descriptor", "cast(null as string) as ldc_string", "cast(null as int) as slot",
    )
    return Catalog(classes, methods.drop("has_code"), methods, items)


@query("""select c_custkey as class_id, case when c_mktsegment = 'BUILDING' then c_nationkey | 64 else c_nationkey end as access_flags from customer""")
def pipe_classes(spark, sf_dir):
    done = Pipeline().on_classes(_C.extends("BUILDING"), transforms.add_flags(64)).apply(catalog(spark, sf_dir))
    return done.classes.select("class_id", "access_flags")


@query("""select c_custkey as class_id, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_orderkey % 3 = 0) and c_nationkey & 1 = 1 then 'pending' else c_name end as name from customer""")
def pipe_methods(spark, sf_dir):
    done = Pipeline().on_methods(_M.named("P") & _M.has_code(), transforms.rename("pending"), _C.flag("public")).apply(catalog(spark, sf_dir))
    return done.classes.select("class_id", "name")


@query("""select o_orderkey as ordinal, case when o_orderstatus = 'F' and c_nationkey + 40 >= 55 then (o_orderkey % 64) | 8 else o_orderkey % 64 end as access_flags from orders join customer on o_custkey = c_custkey""")
def pipe_each(spark, sf_dir):
    done = Pipeline().on_each("methods", _M.named("F"), transforms.add_flags(8), _C.version_at_least(55)).apply(catalog(spark, sf_dir))
    return done.methods.select("ordinal", F.col("access_flags").cast("bigint").alias("access_flags"))


@query("""select l_orderkey, l_linenumber, case when l_returnflag = 'R' and o_orderstatus = 'O' then 'own' else l_linestatus end as owner from lineitem join orders on l_orderkey = o_orderkey""")
def pipe_code(spark, sf_dir):
    done = Pipeline().on_code(_M.named("O"), transforms.redirect_calls(_I.method(), "own", "call")).apply(catalog(spark, sf_dir))
    return done.code_items.select(F.col("method_ordinal").alias("l_orderkey"), F.col("item_ordinal").alias("l_linenumber"), "owner")


@query("""select c_custkey as class_id, upper(c_name) as name, c_nationkey | 1 as access_flags from customer where c_nationkey > 4""")
def pipe_custom(spark, sf_dir):
    """Any function of the catalog between other steps; each sees what those before made."""
    step = lambda c: replace(c, classes=c.classes.withColumn("name", F.upper("name")).where("access_flags > 4"))
    done = Pipeline().custom(step, "upper").on_classes(matchers.anything(), transforms.add_flags(1)).apply(catalog(spark, sf_dir))
    return done.classes.select("class_id", "name", "access_flags")


@query("""select 0 as ordinal, 'rule-1' as rule, 'class' as kind, count(*) as matched_classes, count(*) filter (where c_nationkey & 16 = 0) as changed_classes from customer where c_mktsegment = 'BUILDING'
  union all select 1, 'named', 'field', count(distinct o_custkey), count(distinct o_custkey) from orders where o_orderstatus = 'P'
  union all select 2, 'rule-3', 'method', count(distinct o_custkey), count(distinct o_custkey) from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'O' and cast(l_quantity as integer) = 7""")
def patch_counts(spark, sf_dir):
    rules = patch.load(
        """{"rules": [{"kind": "class", "matcher": {"extends": "BUILDING"}, "action": {"type": "add-access-flags", "flags": ["final"]}},
                      {"kind": "field", "name": "named", "matcher": {"name": "P"}, "action": {"type": "rename", "to": "Q"}},
                      {"kind": "method", "matcher": {"name": "O"}, "code_actions": [{"type": "remove-insn", "matcher": {"opcode": 7}}]}]}"""
    )
    _, counts = patch.apply(catalog(spark, sf_dir), rules)
    return counts.select("ordinal", "rule", "kind", "matched_classes", "changed_classes")


@query("""with i as (select o_custkey as class_id, l_orderkey as method_ordinal, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as l_linenumber, cast(cast(l_quantity as integer) as integer) as opcode, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey),
  r as (select *, 0 as side from i where not (o_orderstatus = 'O' and opcode = 7) union all select class_id, method_ordinal, l_linenumber, 0, o_orderstatus, 1 from i where o_orderstatus = 'O' and opcode = 9)
  select method_ordinal, case when o_orderstatus = 'O' then row_number() over (partition by method_ordinal order by l_linenumber, side) - 1 else l_linenumber end as item_ordinal, opcode from r""")
def patch_code(spark, sf_dir):
    rules = patch.load(
        """{"rules": [{"kind": "method", "matcher": {"name": "O"}, "code_actions": [{"type": "sequence", "actions": [
             {"type": "remove-insn", "matcher": {"opcode": 7}}, {"type": "insert-after", "matcher": {"opcode": 9}, "items": [{"kind": "raw", "opcode": 0}]}]}]}]}"""
    )
    tables = catalog(spark, sf_dir)
    place = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
    items = read(spark, sf_dir, "lineitem").withColumn("item_ordinal", place).join(read(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    items = items.selectExpr("o_custkey as class_id", "l_orderkey as method_ordinal", "item_ordinal", "'raw' as kind", "cast(l_quantity as int) as opcode")
    done, _ = patch.apply(replace(tables, code_items=items), rules)
    return done.code_items.select("method_ordinal", F.col("item_ordinal").cast("bigint").alias("item_ordinal"), "opcode")


# Structural checks

BROKEN = """t as (select p_partkey as class_id, case p_partkey % 7 when 0 then '/' || p_name when 1 then 'a//b' when 2 then 'x;y' else replace(p_name, ' ', '/') end as name, case when p_partkey % 5 = 0 then null else p_brand || case when p_partkey % 6 = 0 then '/' else '' end end as super_name,
  (p_size * 37 % 128) * 512 + p_size % 64 as access_flags, case when p_partkey % 3 = 0 then ['I', 'J', 'I'] else ['K', 'L.M'] end as interfaces, 45 + p_size % 20 as major from part)"""


def broken(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey as class_id", "case p_partkey % 7 when 0 then concat('/', p_name) when 1 then 'a//b' when 2 then 'x;y' else replace(p_name, ' ', '/') end as name", "if(p_partkey % 5 = 0, null, concat(p_brand, if(p_partkey % 6 = 0, '/', ''))) as super_name",
        "(p_size * 37 % 128) * 512 + p_size % 64 as access_flags", "if(p_partkey % 3 = 0, array('I', 'J', 'I'), array('K', 'L.M')) as interfaces", "45 + p_size % 20 as major",
    )


INTERNAL = "({0} <> '' and not starts_with({0}, '/') and not ends_with({0}, '/') and not contains({0}, '//') and not regexp_matches({0}, '[.;\\[]'))"
# The texts of the checks.
_CLASS_RULES = [
    ("class_structure", "ERROR", "'Invalid class name: \"' || name || '\"'", "not " + INTERNAL.format("name")),
    ("class_structure", "ERROR", "'Invalid super class name: \"' || super_name || '\"'", "super_name is not null and not " + INTERNAL.format("super_name")),
    ("class_structure", "WARNING", "'No superclass (only valid for java/lang/Object)'", "super_name is null and name <> 'java/lang/Object'"),
    ("access_flags", "ERROR", "'INTERFACE class must also be ABSTRACT'", "access_flags & 512 <> 0 and access_flags & 1024 = 0"),
    ("access_flags", "ERROR", "'INTERFACE class must not be FINAL'", "access_flags & 512 <> 0 and access_flags & 16 <> 0"),
    ("access_flags", "ERROR", "'INTERFACE class must not be ENUM'", "access_flags & 512 <> 0 and access_flags & 16384 <> 0"),
    ("access_flags", "ERROR", "'ANNOTATION class must also be INTERFACE'", "access_flags & 8192 <> 0 and access_flags & 512 = 0"),
    ("access_flags", "ERROR", "'MODULE class has unexpected flags: 0x' || upper(lpad(to_hex((access_flags & 65535) & ~36864), 4, '0'))", "access_flags & 32768 <> 0 and (access_flags & 65535) & ~36864 <> 0"),
    ("access_flags", "ERROR", "'Class cannot be both FINAL and ABSTRACT'", "access_flags & 1040 = 1040 and access_flags & 512 = 0"),
]


def _union(rules: list[tuple], table: str, columns: str) -> str:
    return " union all ".join(f"select '{severity}' as severity, '{category}' as category, {message} as message, {columns} from {table} where {test}" for category, severity, message, test in rules)


@query(f"""with {BROKEN}, i as (select class_id, name, unnest(interfaces) as interface, generate_subscripts(interfaces, 1) as place from t), n as (select *, row_number() over (partition by class_id, interface order by place) as nth from i)
  {_union(_CLASS_RULES, "t", "class_id, name as class_name")} union all
  select 'ERROR', 'class_structure', 'Invalid interface name: "' || interface || '"', class_id, name from n where not {INTERNAL.format("interface")} union all
  select 'ERROR', 'class_structure', 'Duplicate interface: "' || interface || '"', class_id, name from n where nth > 1""")
def check_classes(spark, sf_dir):
    return verify.class_rules(broken(spark, sf_dir))


OWNED = BROKEN + """, f as (select o_custkey % 300 as class_id, o_orderkey as ordinal, case o_orderkey % 6 when 0 then '' when 1 then 'a.b' else o_orderstatus end as name, case o_orderkey % 4 when 0 then 'I' when 1 then '[J' when 2 then 'X' else 'V' end as descriptor, cast(o_orderkey % 128 as integer) as access_flags from orders),
  j as (select f.*, t.name as class_name, t.access_flags & 512 <> 0 as in_interface, row_number() over (partition by f.class_id, f.name, f.descriptor order by f.ordinal) as nth from f join t using (class_id))"""
_FIELD_RULES = [
    ("class_structure", "ERROR", "'Duplicate field: ' || name || ' ' || descriptor", "nth > 1"),
    ("field", "ERROR", "'Invalid field name: ' || '\"' || name || '\"'", "name in ('', 'a.b')"),
    ("descriptor", "ERROR", "'Invalid field descriptor: \"' || descriptor || '\"'", "descriptor in ('X', 'V')"),
    ("access_flags", "ERROR", "'Field \"' || name || '\" has multiple visibility modifiers'", "bit_count(access_flags & 7) > 1"),
    ("access_flags", "ERROR", "'Field \"' || name || '\" cannot be both FINAL and VOLATILE'", "access_flags & 80 = 80"),
    ("access_flags", "ERROR", "'Interface field \"' || name || '\" must be PUBLIC STATIC FINAL'", "in_interface and access_flags & 25 <> 25"),
]


@query(f"""with {OWNED} {_union(_FIELD_RULES, "j", "class_id, class_name, name as member_name, descriptor as member_descriptor")}""")
def check_fields(spark, sf_dir):
    fields = read(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 300 as class_id", "o_orderkey as ordinal", "case o_orderkey % 6 when 0 then '' when 1 then 'a.b' else o_orderstatus end as name", "case o_orderkey % 4 when 0 then 'I' when 1 then '[J' when 2 then 'X' else 'V' end as descriptor",
        "cast(o_orderkey % 128 as int) as access_flags",
    )
    return verify.field_rules(fields, broken(spark, sf_dir))


METHODS = BROKEN + """, f as (select o_custkey % 300 as class_id, o_orderkey as ordinal, case o_orderkey % 5 when 0 then '<init>' when 1 then '<clinit>' when 2 then '<bad>' else o_orderstatus end as name, case o_orderkey % 3 when 0 then '()V' when 1 then '(I)[J' else '(V)I' end as descriptor,
    cast(o_orderkey * 11 % 2048 as integer) as access_flags, o_orderkey % 4 <> 0 as has_code from orders),
  j as (select f.*, t.name as class_name, t.major, t.access_flags & 512 <> 0 as in_interface, row_number() over (partition by f.class_id, f.name, f.descriptor order by f.ordinal) as nth from f join t using (class_id))"""
_HEX = "'0x' || upper(lpad(to_hex({0}), 4, '0'))"
_METHOD_RULES = [
    ("class_structure", "ERROR", "'Duplicate method: ' || name || descriptor", "nth > 1"),
    ("method", "ERROR", "'Invalid method name: \"' || name || '\"'", "name = '<bad>'"),
    ("descriptor", "ERROR", "'Invalid method descriptor: \"' || descriptor || '\"'", "descriptor = '(V)I'"),
    ("access_flags", "ERROR", "'Method \"' || name || '\" has multiple visibility modifiers'", "bit_count(access_flags & 7) > 1"),
    ("access_flags", "ERROR", "'ABSTRACT method \"' || name || '\" has illegal flags: ' || " + _HEX.format("access_flags & 2362"), "access_flags & 1024 <> 0 and access_flags & 2362 <> 0"),
    ("access_flags", "ERROR", "'Interface method \"' || name || '\" must be PUBLIC ABSTRACT (pre-Java 8)'", "in_interface and name not in ('<init>', '<clinit>') and major < 52 and access_flags & 1025 <> 1025"),
    ("access_flags", "ERROR", "'Interface method \"' || name || '\" must be PUBLIC (or PRIVATE for Java 9+)'", "in_interface and name not in ('<init>', '<clinit>') and major >= 52 and access_flags & 1 = 0 and (major < 53 or access_flags & 2 = 0)"),
    ("method", "ERROR", "'<init> has illegal flags: ' || " + _HEX.format("access_flags & 1400"), "name = '<init>' and access_flags & 1400 <> 0"),
    ("method", "ERROR", "'<clinit> must be STATIC'", "name = '<clinit>' and access_flags & 8 = 0"),
    ("method", "ERROR", "'<clinit> must have descriptor ()V, got \"' || descriptor || '\"'", "name = '<clinit>' and descriptor <> '()V'"),
    ("method", "ERROR", "case when access_flags & 1024 <> 0 then 'ABSTRACT' else 'NATIVE' end || ' method \"' || name || '\" must not have code'", "access_flags & 1280 <> 0 and has_code"),
    ("method", "ERROR", "'Method \"' || name || '\" must have code'", "access_flags & 1280 = 0 and not has_code"),
]


@query(f"""with {METHODS} {_union(_METHOD_RULES, "j", "class_id, class_name, name as member_name, descriptor as member_descriptor")}""")
def check_methods(spark, sf_dir):
    methods = read(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 300 as class_id", "o_orderkey as ordinal", "case o_orderkey % 5 when 0 then '<init>' when 1 then '<clinit>' when 2 then '<bad>' else o_orderstatus end as name", "case o_orderkey % 3 when 0 then '()V' when 1 then '(I)[J' else '(V)I' end as descriptor",
        "cast(o_orderkey * 11 % 2048 as int) as access_flags", "o_orderkey % 4 <> 0 as has_code",
    )
    return verify.method_rules(methods, broken(spark, sf_dir))


@query(f"""with {ITEMS}, m as (select *, user_id * 100 + pos // 5 as method from items), heads as (select distinct method from m), own as (select method, label_id from m where kind = 'label'),
  used as (select method, 'branch target' as context, target_label as label_id from m where kind = 'branch' union all select method, 'switch default', switch_default from m where kind = 'table_switch' union all select method, 'switch case', unnest(switch_labels) from m where kind = 'table_switch')
  select 'WARNING' as severity, 'code' as category, 'Code has empty instruction list' as message, h.method as class_id from heads h where not exists (select 1 from m where m.method = h.method and kind <> 'label')
  union all select 'ERROR', 'code', context || ' references label not in instruction stream', method from used where label_id is not null and not exists (select 1 from own where own.method = used.method and own.label_id = used.label_id)""")
def check_code(spark, sf_dir):
    """Every five items are a method here, so jumps leave it."""
    items = code_items(spark, sf_dir).withColumn("class_id", F.expr("user_id * 100 + pos div 5")).withColumn("method_ordinal", F.lit(0)).withColumn("switch_labels", F.col("switch_labels").cast("array<int>"))
    heads = items.select("class_id").distinct().select("class_id", F.lit(0).alias("ordinal"), F.lit("m").alias("name"), F.lit("()V").alias("descriptor"), F.lit(True).alias("has_code"))
    return verify.code_rules(items, heads).select("severity", "category", "message", "class_id")


ATTRIBUTES = BROKEN + """, a as (select l_orderkey % 300 as class_id, ['class', 'field', 'method', 'code'][1 + l_linenumber % 4] as owner_kind, l_orderkey as owner_ordinal, ['Code', 'Signature', 'Module', 'Record', 'LineNumberTable', 'Own'][1 + l_partkey % 6] as name from lineitem),
  j as (select a.*, t.name as class_name, t.major, t.access_flags & 32768 <> 0 as is_module from a join t using (class_id)),
  several as (select class_id, class_name, owner_kind, owner_ordinal, name from j where name <> 'Own' group by all having count(*) > 1),
  modules as (select t.class_id, t.name as class_name, 'Module' as name from t where t.access_flags & 32768 <> 0 and (select count(*) from j where j.class_id = t.class_id and owner_kind = 'class' and j.name = 'Module') <> 1)"""
_ALLOWED = "((owner_kind = 'class' and name in ('Signature', 'Module', 'Record')) or (owner_kind in ('field', 'method') and name = 'Signature') or (owner_kind = 'method' and name = 'Code') or (owner_kind = 'code' and name = 'LineNumberTable'))"
_ATTRIBUTE_RULES = [
    ("attribute", "ERROR", "name || ' attribute is not allowed on ' || owner_kind", f"name <> 'Own' and not {_ALLOWED}"),
    ("attribute", "ERROR", "name || ' attribute is only allowed on module classes'", "name = 'Module' and not is_module"),
    ("attribute", "ERROR", "name || ' attribute requires class file version ' || case name when 'Module' then 53 else 60 end || '.0 or newer'", "(name = 'Module' and major < 53) or (name = 'Record' and major < 60)"),
]


@query(f"""with {ATTRIBUTES} {_union(_ATTRIBUTE_RULES, "j", "class_id, class_name, name as attribute_name")}
  union all select 'ERROR', 'attribute', owner_kind || ' must not declare multiple ' || name || ' attributes', class_id, class_name, name from several
  union all select 'ERROR', 'attribute', 'module class must declare exactly one Module attribute', class_id, class_name, name from modules""")
def check_attributes(spark, sf_dir):
    attributes = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 300 as class_id", "array('class', 'field', 'method', 'code')[l_linenumber % 4] as owner_kind", "l_orderkey as owner_ordinal", "array('Code', 'Signature', 'Module', 'Record', 'LineNumberTable', 'Own')[l_partkey % 6] as name"
    )
    return verify.attribute_rules(attributes, broken(spark, sf_dir))


# Functions, archives, debug data


@query("""select page_id, case when replace(url, 'http://', '') like '/%' then null else array_to_string(list_filter(string_split(url, '/'), lambda x: x <> '' and x <> '.'), '/') end as entry from pages where not contains(url, '..') and not regexp_matches(url, '^[A-Za-z]:')""")
def entry_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").where("not contains(url, '..') and not url rlike '^[A-Za-z]:'").select("page_id", names.entry_name(F.col("url")).alias("entry"))


RAW_NAMES = "case p_partkey % 5 when 0 then '/' || p_name when 1 then '../' || p_name when 2 then 'a/./' || p_name || '.class' when 3 then 'd//e/' || p_name else p_name || '/..' end"


@query(f"""with r as (select p_partkey, {RAW_NAMES} as raw from part)
  select p_partkey, case when starts_with(raw, '/') or list_contains(string_split(raw, '/'), '..') then null else array_to_string(list_filter(string_split(raw, '/'), lambda x: x <> '' and x <> '.'), '/') end as entry_name, p_partkey % 5 = 2 as is_class from r""")
def archive_entries(spark, sf_dir):
    raw = read(spark, sf_dir, "part").select("p_partkey", F.expr(RAW_NAMES).alias("raw_name"), F.lit(False).alias("is_dir"))
    return archives.named(raw).select("p_partkey", "entry_name", "is_class")


@query(f"""with r as (select p_partkey, {RAW_NAMES} as raw from part) select p_brand as archive, p_partkey as entry_ordinal, raw as raw_name from r join part using (p_partkey) where starts_with(raw, '/') or list_contains(string_split(raw, '/'), '..')""")
def archive_bad_names(spark, sf_dir):
    raw = read(spark, sf_dir, "part").select(F.col("p_brand").alias("archive"), F.col("p_partkey").alias("entry_ordinal"), F.expr(RAW_NAMES).alias("raw_name"), F.lit(False).alias("is_dir"))
    return archives.bad_names(raw)


@query("""select p_partkey, regexp_full_match('rl' || p_size, 'rl[0-9]+') as rl, contains(p_name, 'ring') as in_package, case when contains(p_brand || '/' || p_name, '/') then p_brand else '' end as package from part""")
def name_kinds(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", names.is_rl(F.concat(F.lit("rl"), "p_size")).alias("rl"), names.search(F.col("p_name"), "ring").alias("in_package"), names.package(F.concat("p_brand", F.lit("/"), "p_name")).alias("package"))


@query("""select l_orderkey, l_linenumber, (3 - l_partkey % 4) as padding, case when l_quantity between 0 and 5 then cast(l_quantity as integer) + 3 end as short_constant, case when l_linenumber between 0 and 3 then 26 + 4 * (l_suppkey % 5) + l_linenumber end as shortcut,
          case when 153 + l_partkey % 16 <= 166 then case when (153 + l_partkey % 16) % 2 = 1 then 154 + l_partkey % 16 else 152 + l_partkey % 16 end end as inverted from lineitem""")
def insn_facts(spark, sf_dir):
    i = F.col
    items = read(spark, sf_dir, "lineitem")
    return items.select(
        "l_orderkey", "l_linenumber", opcodes.switch_padding(i("l_partkey")).alias("padding"), opcodes.short_constant(F.lit("int"), i("l_quantity")).alias("short_constant"),
        opcodes.shortcut(0x15 + i("l_suppkey") % 5, i("l_linenumber")).cast("bigint").alias("shortcut"), opcodes.inverted_branch(0x99 + i("l_partkey") % 16).cast("bigint").alias("inverted"),
    )


@query("""select p_partkey, repeat('[', p_size % 3) || 'Lx/' || p_brand || ';' as field, case when p_size % 3 > 0 then repeat('[', p_size % 3 - 1) || 'Lx/' || p_brand || ';' end as component, 'Lx/' || p_brand || ';' as element, case when p_size % 3 = 0 then 'x/' || p_brand end as class_name from part""")
def descriptor_parts(spark, sf_dir):
    field = F.concat(F.expr("repeat('[', p_size % 3)"), F.lit("Lx/"), "p_brand", F.lit(";"))
    return read(spark, sf_dir, "part").select("p_partkey", field.alias("field"), descriptors.component_type(field).alias("component"), descriptors.element_type(field).alias("element"), descriptors.class_name(field).alias("class_name"))


@query("""with a as (select l_orderkey as class_id, l_linenumber, case when l_linestatus = 'O' then 'code' else 'class' end as owner_kind, ['SourceFile', 'LineNumberTable', 'Signature'][1 + l_linenumber % 3] as name from lineitem)
  select class_id, l_linenumber, name from a join orders on o_orderkey = class_id where not (o_orderstatus = 'F' and ((owner_kind = 'class' and name = 'SourceFile') or (owner_kind = 'code' and name = 'LineNumberTable')))""")
def debug_stripped(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as class_id", "l_linenumber", "if(l_linestatus = 'O', 'code', 'class') as owner_kind", "array('SourceFile', 'LineNumberTable', 'Signature')[l_linenumber % 3] as name")
    classes = debug.mark_stale(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("class_id"), "o_orderstatus"), F.col("o_orderstatus") == "F")
    return debug.strip(rows, classes).select("class_id", "l_linenumber", "name")


@query("""select 'WARNING' as severity, 'attribute' as category, 'Class debug metadata is marked stale and will be stripped during lowering' as message, p_partkey as class_id, p_name as class_name from part where p_size > 25""")
def check_stale_debug(spark, sf_dir):
    classes = debug.mark_stale(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("class_id"), F.col("p_name").alias("name"), "p_size"), F.col("p_size") > 25)
    return verify.stale_debug_rules(classes)


@query(f"""with {MEMBERS} select name as child, super_name as parent, 0 as edge_ordinal, 'super' as kind from m union all
  select name, unnest(interfaces), generate_subscripts(interfaces, 1), 'interface' from m""")
def hierarchy_edges(spark, sf_dir):
    return hierarchy.edges_of(members(spark, sf_dir)).withColumn("edge_ordinal", F.col("edge_ordinal").cast("bigint"))


@query("""select c_custkey as child, c_nationkey * 100 as parent from customer where c_nationkey * 100 not in (select c_custkey from customer)""")
def hierarchy_unresolved(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    edges = customers.select("c_custkey", (F.col("c_nationkey") * 100).cast("bigint").alias("parent")).withColumnRenamed("c_custkey", "child")
    return hierarchy.unresolved(edges.withColumn("parent", F.col("parent").cast("string")), customers.select(F.col("c_custkey").cast("string").alias("name"))).select("child", F.col("parent").cast("bigint").alias("parent"))


@query("""select c_custkey, c_name from customer""")
def unique_keys(spark, sf_dir):
    return reports.unique_or_fail(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
