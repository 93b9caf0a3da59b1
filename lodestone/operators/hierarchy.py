"""Class hierarchies: closures over an edge table (child, parent, edge_ordinal, kind).

Edge 0 of a class is its super class, the others its interfaces in order.
Closures double their reach every round and keep of each pair the first visit:
lowest depth, then lowest path of ordinals.  Super edges alone are a forest: its
chains, circles and common classes come from lifting (lodestone.operators.ancestry).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import ancestry
from lodestone.sources.scratch import Scratch

OBJECT = "java/lang/Object"


def edges_of(classes: DataFrame) -> DataFrame:
    """Edges of a table (name, super_name, interfaces); the root class is made up: what the table says of it goes."""
    known = classes.where(F.col("name") != OBJECT)
    up = F.array_compact(F.concat(F.array(F.struct(F.lit(0).alias("edge_ordinal"), F.col("super_name").alias("parent"))), F.transform(F.coalesce("interfaces", F.array().cast("array<string>")), lambda x, i: F.struct((i + 1).alias("edge_ordinal"), x.alias("parent")))))
    rows = known.select(F.col("name").alias("child"), F.explode(up).alias("e")).select("child", "e.parent", "e.edge_ordinal")
    return rows.where(F.col("parent").isNotNull()).withColumn("kind", F.when(F.col("edge_ordinal") == 0, "super").otherwise("interface"))


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor, depth, path): every ancestor but the child itself, at its first visit.  Cycles are absorbed.

    A first visit of depth 2^k + m goes on by a first visit of depth m from where a first visit of depth 2^k ends, so
    after k rounds all of up to 2^k steps are known, and one round without new pairs ends the search.
    """
    save = Scratch(edges.sparkSession).write
    best = F.min(F.struct("depth", "path")).alias("v")
    near = edges.where(F.col("child") != F.col("parent")).select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.array(F.col("edge_ordinal").cast("int")).alias("path"))
    rounds, reach = [save(near.groupBy("child", "ancestor").agg(best).select("child", "ancestor", "v.*"))], 1
    while True:
        known = reduce(DataFrame.unionByName, rounds)
        first = rounds[-1].where(F.col("depth") == reach).select("child", F.col("ancestor").alias("middle"), F.col("path").alias("_path"))
        onward = known.select(F.col("child").alias("middle"), "ancestor", "depth", "path")
        new = first.join(onward, "middle").where(F.col("child") != F.col("ancestor")).select("child", "ancestor", (F.col("depth") + reach).alias("depth"), F.concat("_path", "path").alias("path"))
        new = save(new.join(known, ["child", "ancestor"], "left_anti").groupBy("child", "ancestor").agg(best).select("child", "ancestor", "v.*"))
        if new.isEmpty():
            return known
        rounds.append(new)
        reach *= 2


def visit_order(closed: DataFrame) -> DataFrame:
    """closed with position: the order in which a breadth-first walk meets each child's ancestors, from 0."""
    return closed.withColumn("position", F.row_number().over(Window.partitionBy("child").orderBy("depth", "path")) - 1)


def super_lifting(edges: DataFrame) -> ancestry.Lifting:
    """The super edges alone, lifted."""
    return ancestry.lift(edges.where("kind = 'super'").select("child", "parent"))


def superclasses(edges: DataFrame) -> DataFrame:
    """(child, ancestor, depth) by super edges only, nearest first; the root is added where a chain ends elsewhere.

    Classes whose chain runs into a circle have no rows: superclass_chain() tells them.
    """
    lifting = super_lifting(edges)
    chain = ancestry.chains(lifting).select(F.col("node").alias("child"), "ancestor", "depth")
    tops = edges.select(F.col("child").alias("node")).distinct().join(lifting.endless.select("node"), "node", "left_anti").join(lifting.tops, "node", "left")
    ends = tops.where((F.col("node") != OBJECT) & (F.coalesce("top", "node") != OBJECT))
    return chain.unionAll(ends.select(F.col("node").alias("child"), F.lit(OBJECT).alias("ancestor"), (F.coalesce("depth", F.lit(0)) + 1).alias("depth")))


def superclass_chain(edges: DataFrame, classes: DataFrame | None = None, children: DataFrame | None = None) -> DataFrame:
    """(child, depth, ancestor, error) of each child (all, or those of (child)): its super classes, or one row with what is wrong.

    A chain into a circle is an error "cycle" at the smallest class of that circle; one that ends at a class which is not
    among `classes` (name) is an error "unresolved" at that class.  Such a child has no other row, and depth 0.
    """
    lifting = super_lifting(edges)
    tops = lifting.tops
    if classes is not None:
        tops = tops.join(classes.select(F.col("name").alias("top"), F.lit(True).alias("_known")).distinct(), "top", "left")
        known = F.coalesce("_known", F.lit(False))
        lifting = ancestry.Lifting(lifting.levels, tops.where(known).select("node", "top", "depth"), lifting.endless)
        unknown = tops.where(~known).select("node", F.lit("unresolved").alias("error"), F.col("top").alias("at"))
    wrong = lifting.endless.select("node", F.lit("cycle").alias("error"), F.col("low").alias("at"))
    wrong = wrong if classes is None else wrong.unionAll(unknown)
    only = None if children is None else children.select(F.col("child").alias("node"))
    if only is not None:
        wrong = wrong.join(only, "node", "left_semi")
    whole = ancestry.chains(lifting, only).select(F.col("node").alias("child"), "depth", "ancestor", F.lit(None).cast("string").alias("error"))
    return whole.unionAll(wrong.select(F.col("node").alias("child"), F.lit(0).cast("long").alias("depth"), F.col("at").alias("ancestor"), "error"))


def cycles(edges: DataFrame) -> DataFrame:
    """(child, circle) of the classes that their own super chain reaches again, with the smallest class of that circle."""
    return super_lifting(edges).circles().select(F.col("node").alias("child"), "circle")


def unresolved(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(child, parent) of the edges to classes that are not known; the root always is."""
    return edges.where(F.col("parent") != OBJECT).join(classes.select(F.col("name").alias("parent")), "parent", "left_anti").select("child", "parent")


def is_subtype(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """pairs (child, ancestor) with is_subtype: equal, or an ancestor."""
    known = closed.select("child", "ancestor").distinct().withColumn("_known", F.lit(True))
    return pairs.join(known, ["child", "ancestor"], "left").withColumn("is_subtype", (F.col("child") == F.col("ancestor")) | F.coalesce("_known", F.lit(False))).drop("_known")


def common_superclass(pairs: DataFrame, lifting: ancestry.Lifting, root: str | Column = OBJECT) -> DataFrame:
    """pairs (a, b) with common: equal names are themselves, arrays have the root, others the first of a's chain (a included) in b's.

    Names without a common class have the root, chains into circles included.
    """
    base = root if isinstance(root, Column) else F.lit(root)
    array = F.col("a").cast("string").startswith("[") | F.col("b").cast("string").startswith("[")
    plain = (F.col("a") != F.col("b")) & ~array
    nearest = ancestry.common_ancestors(pairs.where(plain), lifting)
    out = pairs.join(nearest, ["a", "b"], "left")
    return out.withColumn("common", F.when(F.col("a") == F.col("b"), F.col("a")).when(array, base).otherwise(F.coalesce("common", base)))


def overridden(methods: DataFrame, closed: DataFrame, package: Column | None = None) -> DataFrame:
    """(owner, name, descriptor, overrides, depth) for methods (owner, name, descriptor, access_flags, package).

    Constructors, initializers, private and static methods override nothing; private, static, final and foreign
    package-private ones are not overridden.
    """
    hidden = F.col("access_flags").bitwiseAND(F.lit(0x0002 | 0x0008)) != 0
    own = methods.where(~hidden & ~F.col("name").isin("<init>", "<clinit>"))
    over = methods.where(~hidden & (F.col("access_flags").bitwiseAND(F.lit(0x0010)) == 0))
    several = methods.groupBy("name", "descriptor").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low <> high").select("name", "descriptor")
    own = own.join(several, ["name", "descriptor"], "left_semi")  # the others meet no method above them
    above = over.select(F.col("owner").alias("overrides"), "name", "descriptor", F.col("access_flags").alias("_flags"), F.col("package").alias("_package"))
    pairs = own.select("owner", "name", "descriptor", "package").join(closed.select(F.col("child").alias("owner"), F.col("ancestor").alias("overrides"), "depth"), "owner")
    seen = (F.col("_flags").bitwiseAND(F.lit(0x0001 | 0x0004)) != 0) | (F.col("package") == F.col("_package"))
    return pairs.join(above, ["overrides", "name", "descriptor"]).where(seen).select("owner", "name", "descriptor", "overrides", "depth")
