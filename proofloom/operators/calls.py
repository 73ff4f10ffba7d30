"""Call resolution in an ordered fallback of seven tiers, over scope trees, imports and re-exports.

Calls are reduced to distinct requests first, and declarations to a count and the least of them for each way to be found, so no join
carries the declarations of a name to each of its calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import discard, written

#: The tiers, first to last, and the most re-exports that an export is followed through.
TIERS = ("local_shadow", "self_receiver", "import", "same_scope", "enclosing_scope", "glob_import", "name")
MOST_REEXPORTS = 8
_PLACES = (*TIERS, "none")
_REQUEST = ["file", "scope", "owner", "form", "name"]


def enclosing(scope: Column) -> Column:
    """The scope and those around it, nearest first; the file's own is the empty text."""
    parts = F.filter(F.split(scope, r"\."), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def _counted(declared: DataFrame, *by: str) -> DataFrame:
    return declared.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))


def exported(wanted: DataFrame, declared: DataFrame, aliases: DataFrame, reexports: DataFrame, most: int = MOST_REEXPORTS) -> DataFrame:
    """(file, name, n, k): how many declarations each wanted export (file, name) comes to, and the least of them; none: no row.

    declared(k, file, name): what may be exported. aliases(file, exported, name): a declaration's other name outside. reexports(file,
    exported, module, imported), exported '*' for all names. An export that the file declares ends there; else all re-exports that fit are
    followed, `most` of them in a row at most. A (file, name) that a request has met before isn't followed again: it was nearer then, so cycles
    end and nothing is lost. Several ways to one declaration count once.
    """
    named = reexports.where("exported <> '*'").select("file", F.col("exported").alias("name"), "module", "imported").distinct()
    stars = reexports.where("exported = '*'").select("file", "module").distinct()
    alias = aliases.groupBy("file", F.col("exported").alias("name")).agg(F.min("name").alias("inner"))

    def localised(rows: DataFrame) -> DataFrame:
        return rows.join(alias, ["file", "name"], "left").withColumn("name", F.coalesce("inner", "name")).drop("inner")

    own = declared.select("file", "name").distinct()
    front = written(localised(wanted.select("file", "name").distinct().select(F.col("file").alias("of_file"), F.col("name").alias("of_name"), "file", "name")), "exports")
    seen, met = front, []
    for depth in range(most + 1):
        met.append(written(front.join(own, ["file", "name"], "left_semi"), "exports-met"))
        if depth == most:
            break
        left = front.join(own, ["file", "name"], "left_anti")
        step = left.join(named, ["file", "name"]).select("of_file", "of_name", F.col("module").alias("file"), F.col("imported").alias("name"))
        step = step.unionByName(left.join(stars, "file").select("of_file", "of_name", F.col("module").alias("file"), "name"))
        front = written(localised(step).distinct().join(seen, ["of_file", "of_name", "file", "name"], "left_anti"), "exports")
        if front.isEmpty():
            discard(front)
            break
        seen = seen.unionByName(front)
    ends = met[0]
    for more in met[1:]:
        ends = ends.unionByName(more)
    ends = ends.join(declared.select("file", "name", "k"), ["file", "name"]).select("of_file", "of_name", "k").distinct()
    return ends.groupBy(F.col("of_file").alias("file"), F.col("of_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))


def _narrow(kind: str, exact: Column | bool, n: Column, k: Column) -> Column:
    """A tier's answer as it is joined and kept: the tier's place, candidates, the one candidate, and whether scopes pinned it or only its name."""
    exact = F.lit(exact) if isinstance(exact, bool) else exact
    return F.struct(F.lit(_PLACES.index(kind)).cast("byte").alias("t"), n.cast("long").alias("n"), F.when(n == 1, k).alias("k"), exact.alias("e"))


def _wide(r: Column) -> Column:
    sure = F.when(r["n"] == 0, "unresolved").when(r["n"] > 1, "ambiguous").when(r["e"], "exact").otherwise("name_only")
    return F.struct(F.get(F.array(*[F.lit(t) for t in _PLACES]), r["t"].cast("int")).alias("tier"), r["n"].alias("candidates"), r["k"].alias("target"), sure.alias("confidence"))


def resolved(sites: DataFrame, declared: DataFrame, shadows: DataFrame, imports: DataFrame, globs: DataFrame, aliases: DataFrame, reexports: DataFrame) -> DataFrame:
    """(call_id, caller, r): the first tier that binds each call, narrow; tier `none` where no tier does. A table.

    sites(call_id, caller, file, scope, owner, form, name): form `self` or `plain`. declared(k, file, scope, owner, name, public): without an
    owner a function, else its method. shadows(caller, name): names bound in a body. imports(file, place, local, module, imported),
    globs(file, place, module); a module that declares and re-exports nothing is a package.

    A shadowed plain name binds to nothing that is known. A call on self meets the methods of its owner in the file, then elsewhere, then
    methods of any owner by name. A plain name: the file's first import of it, which binds even if it comes to nothing (of a package:
    public functions of the imported name); functions of its scope, then of the nearest enclosing scope that has one; public
    top-level functions of the first glob import that has one; functions of that name anywhere. target is the one candidate.
    """
    free, methods = declared.where("owner IS NULL"), declared.where("owner IS NOT NULL")
    requests = written(sites.select(*_REQUEST).distinct(), "requests")
    plain = requests.where("form = 'plain'")
    asked = plain.select("file", "name").distinct()

    public = free.where("public").select("k", "file", "name")
    bound = imports.groupBy("file", F.col("local").alias("name")).agg(F.min(F.struct("place", "module", "imported")).alias("i")).join(asked, ["file", "name"], "left_semi")
    bound = written(bound.select("file", "name", "i.module", "i.imported"), "bound")
    modules = declared.select(F.col("file").alias("module")).union(reexports.select(F.col("file").alias("module"))).distinct().withColumn("known", F.lit(True))
    ends = exported(bound.join(modules, "module", "left_semi").select(F.col("module").alias("file"), F.col("imported").alias("name")), public, aliases, reexports)
    any_public = _counted(public, "name").select(F.col("name").alias("imported"), F.col("n").alias("pn"), F.col("k").alias("pk"))
    by_import = bound.join(modules, "module", "left").join(ends.select(F.col("file").alias("module"), F.col("name").alias("imported"), "n", "k"), ["module", "imported"], "left").join(any_public, "imported", "left")
    known = F.coalesce("known", F.lit(False))
    n, k = F.coalesce(F.when(known, F.col("n")).otherwise(F.col("pn")), F.lit(0)), F.when(known, F.col("k")).otherwise(F.col("pk"))
    by_import = by_import.select("file", "name", _narrow("import", known, n, k).alias("by_import"))

    scoped = written(_counted(free, "file", "scope", "name"), "scoped")
    around = plain.select("file", "scope", "name").distinct().select("file", "name", F.col("scope").alias("from"), F.posexplode(enclosing(F.col("scope"))).alias("up", "scope"))
    near = around.join(scoped, ["file", "scope", "name"]).groupBy("file", F.col("from").alias("scope"), "name").agg(F.min(F.struct("up", "n", "k")).alias("s"))
    same, outer = _narrow("same_scope", True, F.col("s.n"), F.col("s.k")), _narrow("enclosing_scope", True, F.col("s.n"), F.col("s.k"))
    by_scope = near.select("file", "scope", "name", F.when(F.col("s.up") == 0, same).otherwise(outer).alias("by_scope"))

    tops = _counted(free.where("public AND scope = ''"), "file", "name").select(F.col("file").alias("module"), "name", "n", "k")
    by_glob = asked.join(globs, "file").join(tops, ["module", "name"]).groupBy("file", "name").agg(F.min(F.struct("place", "n", "k")).alias("g"))
    by_glob = by_glob.select("file", "name", _narrow("glob_import", True, F.col("g.n"), F.col("g.k")).alias("by_glob"))
    by_name = _counted(free, "name").select("name", _narrow("name", False, F.col("n"), F.col("k")).alias("by_name"))

    in_file = _counted(methods, "owner", "file", "name").select("owner", "file", "name", _narrow("self_receiver", True, F.col("n"), F.col("k")).alias("in_file"))
    of_owner = _counted(methods, "owner", "name").select("owner", "name", _narrow("self_receiver", False, F.col("n"), F.col("k")).alias("of_owner"))
    any_owner = _counted(methods, "name").select("name", _narrow("name", False, F.col("n"), F.col("k")).alias("any_owner"))

    by_file = plain.join(by_import, ["file", "name"], "left").join(by_glob, ["file", "name"], "left").join(by_scope, ["file", "scope", "name"], "left")
    named = by_file.select(*_REQUEST, F.coalesce("by_import", "by_scope", "by_glob").alias("r")).join(by_name, "name", "left").select(*_REQUEST, F.coalesce("r", "by_name").alias("r"))
    received = requests.where("form = 'self'").join(in_file, ["owner", "file", "name"], "left").join(of_owner, ["owner", "name"], "left")
    received = received.select(*_REQUEST, F.coalesce("in_file", "of_owner").alias("r")).join(any_owner, "name", "left").select(*_REQUEST, F.coalesce("r", "any_owner").alias("r"))
    none = lambda kind: _narrow(kind, False, F.lit(0), F.lit(None).cast(declared.schema["k"].dataType))
    answers = written(named.unionByName(received), "answers")
    hidden = shadows.select("caller", "name").distinct().withColumn("hidden", F.lit(True))
    told = sites.join(hidden, ["caller", "name"], "left").alias("s")
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}")) for c in _REQUEST]
    joined = told.join(answers.alias("a"), on[0] & on[1] & on[2] & on[3] & on[4], "left").select("s.call_id", "s.caller", "s.form", "hidden", "r")
    best = F.when(F.col("hidden") & (F.col("form") == "plain"), none("local_shadow")).otherwise(F.coalesce("r", none("none")))
    met = written(joined.select("call_id", "caller", best.alias("r")), "calls")
    discard(bound, scoped, requests, answers)
    return met


def resolve(sites: DataFrame, declared: DataFrame, shadows: DataFrame, imports: DataFrame, globs: DataFrame, aliases: DataFrame, reexports: DataFrame) -> DataFrame:
    """(call_id, tier, candidates, target, confidence): the first tier that binds each call, as resolved() says."""
    return resolved(sites, declared, shadows, imports, globs, aliases, reexports).select("call_id", _wide(F.col("r")).alias("r")).select("call_id", "r.*")


def edges(met: DataFrame) -> DataFrame:
    """(caller, target, confidence, calls) of resolved() calls: each caller's calls of one target, with the surest confidence among them."""
    sums = met.where("r.k IS NOT NULL").groupBy("caller", F.col("r.k").alias("target")).agg(F.max("r.e").alias("e"), F.count(F.lit(1)).alias("calls"))
    return sums.select("caller", "target", F.when(F.col("e"), "exact").otherwise("name_only").alias("confidence"), "calls")
