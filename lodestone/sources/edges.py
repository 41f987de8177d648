"""Typed call edges of a base, kept as a table.

One row an edge: the module whose text it stands in, the method it leaves (`src`), what it
names (`dst`), its kind, its line in the module and what surrounds it:

* `code`: `Module.Name(` where the base has a common module of that name, or `Name(` where
  the same object has a method of that name;
* `unconfirmed`: `Left.Name(` through anything else (an object, a variable), with `Left`;
* `string`: `Вычислить("Name")` or `Выполнить("Module.Name")`: a name in a literal;
* `intercept`: an interception directive of the method `src`, which replaces `dst`;
* `event`: a subscription `src` whose handler is `dst`.

Ends are `object path/method name` in lower case; where only a name is known, the path is
empty. Parsing is by module: a row carries the digest of its module's methods, so `refresh`
parses the modules that changed, drops those of modules that are gone, and keeps the
others' rows. Kinds depend on other modules' names too, so they are resolved by joins for
all rows, parsed anew or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import code as C
from lodestone.operators import code as K

#: Columns that a parse gives, before names are resolved.
PARSED = ["module_id", "digest", "object_id", "code_name", "method", "line", "form", "left", "name", "conditions"]


def module_digests(methods: DataFrame) -> DataFrame:
    """(module_id, digest): a digest of the module's methods that no order of rows changes."""
    one = F.xxhash64("name", "directives", "line_start", "body")
    other = F.xxhash64(F.lit(1), "name", "directives", "line_start", "body")
    return methods.groupBy("module_id").agg(F.concat_ws("-", F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.sum(other.cast("decimal(38,0)"))).alias("digest"))


def parse(methods: DataFrame, modules: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """PARSED rows of ``methods``: calls in their bodies and interceptions in their directives."""
    m = methods.join(modules.select(F.col("id").alias("module_id"), "object_id", "code_name"), "module_id")
    m = m.join(module_digests(methods) if digests is None else digests, "module_id")
    keys = ["module_id", "digest", "object_id", "code_name", "method", "first"]
    m = m.select("module_id", "digest", "object_id", "code_name", F.col("name").alias("method"), F.coalesce("line_start", F.lit(1)).alias("first"), "body", "directives")
    calls = K.call_facts(m, keys, "body").withColumn("line", F.col("first") + F.col("line") - 1)
    hooks = K.expand(m, keys, "directives", "how string, target string", C.intercepts)
    none = F.lit(None).cast("string")
    hooks = hooks.select(*keys, F.col("first").alias("line"), F.concat(F.lit("&"), "how").alias("form"), none.alias("left"), F.col("target").alias("name"), F.array().cast("array<string>").alias("conditions"))
    return calls.select(*PARSED).unionByName(hooks.select(*PARSED))


def refresh(old: DataFrame | None, methods: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all PARSED rows, the modules parsed): rows of unchanged modules come from ``old``."""
    digests = module_digests(methods)
    if old is None:
        return parse(methods, modules, digests), digests.select("module_id")
    # a module without any call has no row, so it is parsed again: that costs its size and gives nothing
    kept = old.join(digests, ["module_id", "digest"], "left_semi")
    names = modules.select(F.col("id").alias("module_id"), F.col("object_id").alias("o"), F.col("code_name").alias("c"))
    kept = kept.join(names, "module_id").withColumns({"object_id": F.col("o"), "code_name": F.col("c")})  # ids of objects may have moved
    fresh = digests.join(old.select("module_id", "digest").distinct(), ["module_id", "digest"], "left_anti").select("module_id")
    parsed = parse(methods.join(fresh, "module_id", "left_semi"), modules, digests)
    return kept.select(*PARSED).unionByName(parsed), fresh


def resolve(parsed: DataFrame, objects: DataFrame, methods: DataFrame, modules: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """The typed edges. ``events``: (path, handler_path, method) of subscriptions."""
    low = lambda c: F.lower(c)
    names = objects.select(F.col("id").alias("object_id"), "path", "type", "name")
    own = methods.join(modules.select(F.col("id").alias("module_id"), "object_id"), "module_id").select("object_id", low(F.col("name")).alias("n")).distinct()
    common = names.where("type = 'CommonModule'").groupBy(low(F.col("name")).alias("l")).agg(F.min("path").alias("module_path"))
    rows = parsed.join(names.select("object_id", "path"), "object_id").withColumn("n", low(F.col("name"))).withColumn("l", low(F.col("left")))
    rows = rows.join(common, "l", "left").join(own.withColumn("known", F.lit(True)), ["object_id", "n"], "left")
    form = F.col("form")
    hook = form.startswith("&")
    kind = (F.when(hook, "intercept").when(form == "string", "string").when(F.col("module_path").isNotNull(), "code")
        .when((form == "plain") & F.col("known"), "code").when(form == "plain", F.lit(None)).otherwise("unconfirmed"))
    place = F.coalesce(F.col("module_path"), F.when((form == "plain") | hook | ((form == "string") & F.col("left").isNull() & F.col("known")), F.col("path")), F.lit(""))
    end = lambda path, name: F.concat(low(path), F.lit("/"), low(name))
    out = rows.withColumn("kind", kind).where("kind is not null").select(
        "kind", end(F.col("path"), F.col("method")).alias("src"), end(place, F.col("name")).alias("dst"), "path", "code_name", "method", "line", "left", "name", "form", "conditions", "module_id")
    if events is None:
        return out
    none = lambda t: F.lit(None).cast(t)
    return out.unionByName(events.select(
        F.lit("event").alias("kind"), low(F.col("path")).alias("src"), end(F.col("handler_path"), F.col("method")).alias("dst"), "path", none("string").alias("code_name"), none("string").alias("method"),
        none("int").alias("line"), none("string").alias("left"), F.col("method").alias("name"), F.lit("event").alias("form"), F.array().cast("array<string>").alias("conditions"), none("long").alias("module_id")))


def callers(edges: DataFrame, path: str, name: str, depth: int) -> DataFrame:
    """Edges that lead to a method within ``depth`` steps, each with its least step; only `code` edges are followed.

    A call through an unknown left side names a method of that name anywhere, so it is an edge
    of the first step to every method of the name."""
    start = f"{path.lower()}/{name.lower()}"
    return _walk(edges, start, depth, "dst", "src")


def callees(edges: DataFrame, path: str, name: str, depth: int) -> DataFrame:
    """Edges that leave a method within ``depth`` steps, each with its least step."""
    return _walk(edges, f"{path.lower()}/{name.lower()}", depth, "src", "dst")


def _walk(edges: DataFrame, start: str, depth: int, at: str, to: str) -> DataFrame:
    spark = edges.sparkSession
    node = spark.range(1).select(F.lit(start).alias("node"))
    seen, frontier, out = node, node, None
    loose = F.concat(F.lit("/"), F.substring_index("node", "/", -1))
    for step in range(1, depth + 1):
        near = frontier.select(F.col("node").alias(at))
        if at == "dst":
            near = near.union(frontier.select(loose.alias(at))).distinct()
        found = edges.join(near, at, "left_semi").withColumn("depth", F.lit(step))
        out = found if out is None else out.unionByName(found)
        frontier = found.where("kind = 'code'").select(F.col(to).alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.unionByName(frontier)
    return out
