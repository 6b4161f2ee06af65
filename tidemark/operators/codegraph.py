"""Graphs of code: symbols and files as (id, kind, file_path, class_name, method_name, language), edges as (src, dst, relation).

Resolution and labels are joins; nothing walks the graph on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import graph
from tidemark.operators.tables import language
from tidemark.storage import cut, stored

# Kinds of paths, the first that fits counts; ranks of entries; roles by a word of the name.
PATH_KINDS = (
    ("tests", r"(?i)(^|/)tests?/|(^|/)src/test/"),
    ("portlet", r"(?i)portlet"),
    ("controller", r"(?i)controller"),
    ("service", r"(?i)\bservice\b"),
    ("data_access", r"(?i)repository|repo\b|dao\b"),
    ("api", r"(?i)api[/\\]|/api\b"),
    ("model", r"(?i)model|entity|domain"),
    ("util", r"(?i)util|helper|common"),
)
ENTRY_RANKS = {"api_rest": 0, "portlet": 0, "kafka": 1, "queue": 1, "scheduler": 2, "main": 3, "cli": 4, "unknown": 5}
ROLES = (
    ("controller", "controller layer"), ("service", "service layer"), ("repository", "repository / persistence"), ("repo", "repository / persistence"),
    ("handler", "handler"), ("consumer", "consumer"), ("producer", "producer"), ("listener", "event listener"),
)
# Questions in words, intents by the words that show them; the first that fits counts.
INTENTS = (
    ("called_by", ("called by", "who calls")),
    ("impact", ("impact", "affected", "downstream")),
    ("references", ("references", "depends on")),
    ("semantic_search", ("similar", "related", " like ")),
    ("event_flow", ("kafka", "event")),
)
TOPIC = r"""(?:\.send\s*\(\s*|ProducerRecord\s*(?:<[^>]*>)?\s*\(\s*)["']([^"']+)["']"""


# Names and paths


def file_node(path: Column) -> Column:
    return F.concat(F.lit("file:"), F.replace(path, F.lit("\\"), F.lit("/")))


def symbol_tail(symbol: Column) -> Column:
    """What stands behind the last ``::``."""
    return F.substring_index(symbol, "::", -1)


def call_confidence(resolution: Column) -> Column:
    return F.when(resolution == "unknown", 0.5).when(resolution == "dynamic", 0.7).otherwise(1.0)


def path_kind(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATH_KINDS):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def entry_rank(kind: Column) -> Column:
    out = F.when(F.coalesce(kind, F.lit("")) == "", 90).otherwise(50)
    for name, rank in reversed(ENTRY_RANKS.items()):
        out = F.when(kind == name, rank).otherwise(out)
    return out


def ranked_entries(entries: DataFrame, kinds: list[str] | None = None, n: int | None = None) -> DataFrame:
    """(id, kind, rank) of entries of the wanted kinds, by rank, then id; the first ``n``."""
    kept = entries.where(F.col("kind").isin(kinds)) if kinds else entries
    ordered = kept.select("id", "kind", entry_rank(F.col("kind")).alias("rank")).orderBy("rank", "id")
    return ordered.limit(n) if n else ordered


def matching_symbols(symbols: DataFrame, pattern: str, n: int) -> DataFrame:
    """The first ``n`` symbols, by id, whose id matches a pattern."""
    return symbols.where(F.col("id").rlike(pattern)).orderBy("id").limit(n)


def method_roles(symbols: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """(id, role): where a flow starts, decides, ends, or else what the name tells."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.count_if(F.col("condition").isNotNull()).alias("n_conditional"))
    name = F.lower(F.concat(F.coalesce("class_name", F.lit("")), F.lit("."), F.coalesce("method_name", F.lit(""))))
    told = F.lit(None).cast("string")
    for word, role in reversed(ROLES):
        told = F.when(F.contains(name, F.lit(word)), role).otherwise(told)
    role = F.when(F.col("id") == start, "start method").when(F.coalesce("n_conditional", F.lit(0)) > 0, "decision logic")
    rest = F.when(F.col("n_out").isNull(), "leaf / terminal").otherwise("processing method")
    return symbols.join(out, "id", "left").select("id", F.coalesce(role, told, rest).alias("role"))


def module_counts(symbols: DataFrame, path: str = "file_path") -> DataFrame:
    """(module, n): symbols by the first segment of their path."""
    return symbols.groupBy(F.split_part(path, F.lit("/"), F.lit(1)).alias("module")).agg(F.count("*").alias("n"))


def dominant_kind(rows: DataFrame, group: str, path: str) -> DataFrame:
    """(group, bucket, n): the kind that most paths of a group have, the first by name of equals; groups without any are left out."""
    counts = rows.select(group, path_kind(F.col(path)).alias("bucket")).where("bucket IS NOT NULL").groupBy(group, "bucket").agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.min(F.struct(-F.col("n"), "bucket")).alias("best"))
    return best.select(group, F.col("best.bucket").alias("bucket"), (-F.col("best.col1")).alias("n"))


def embedding_text(symbols: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """(id, text): name, class, path, language and the first ``n`` callees of a symbol, for a model."""
    calls = edges.where("relation = 'CALLS'").select("src", symbol_tail(F.col("dst")).alias("callee")).distinct()
    first = calls.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("callee"))).where(F.col("k") <= n)
    told = first.groupBy(F.col("src").alias("id")).agg(F.concat(F.lit("calls: "), F.array_join(F.array_sort(F.collect_list("callee")), ", ")).alias("calls"))
    return symbols.join(told, "id", "left").select("id", F.concat_ws(" ", "method_name", "class_name", "file_path", "language", "calls").alias("text"))


# Joins


def symbols_in(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of symbols whose file is among the changed paths (path), or below one: prefixes of a path are joined by equality."""
    parts = F.split(F.replace("file_path", F.lit("\\"), F.lit("/")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    probed = symbols.where("file_path <> ''").select("id", F.explode(above).alias("path"))
    return probed.join(changed.select(F.regexp_replace("path", "/+$", "").alias("path")).distinct(), "path").select("id").distinct()


def best_callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call, callee) of each call of (call, label, file_path): of the symbols whose name is the label, one of the same file, then the shortest, then the first id.

    One of the same file goes before all others, so that the best symbol of each label and of each label and file will do; a call never meets all symbols of its name.
    """
    tail = F.when(symbol_tail(F.col("id")) == F.col("method_name"), 1).otherwise(0)
    named = symbols.select(F.col("method_name").alias("label"), F.col("file_path").alias("in_file"), F.struct((-tail).alias("score"), F.length("id").alias("size"), F.col("id").alias("callee")).alias("best"))
    in_files = stored(named.groupBy("label", "in_file").agg(F.min("best").alias("here")), "best-of-files")
    anywhere = in_files.groupBy("label").agg(F.min("here").alias("best"))
    asked = calls.select("label", "file_path").distinct().join(anywhere, "label")
    known = asked.join(in_files.withColumnRenamed("label", "name"), (F.col("label") == F.col("name")) & (F.col("file_path") == F.col("in_file")), "left")
    top = F.when(F.col("here").isNotNull(), F.struct((F.col("here.score") - 2).alias("score"), "here.size", "here.callee")).otherwise(F.col("best"))
    known = known.select(F.col("label").alias("name"), F.col("file_path").alias("from_file"), top.alias("top"))
    found = calls.join(known, (F.col("label") == F.col("name")) & F.col("file_path").eqNullSafe(F.col("from_file")))
    return found.groupBy("call").agg(F.min("top")["callee"].alias("callee"))


def expanded_modules(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(src, module, path): modules by aliases (pattern, base) that may end in ``/*``; what a star stood for is put behind the base.

    A module is exploded into its prefixes, which join the patterns by equality; of the patterns that fit, the longest counts.
    """
    parts = F.split("module", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    stem = lambda c: F.regexp_replace(c, r"/\*$", "")
    known = aliases.select(stem(F.col("pattern")).alias("prefix"), F.col("pattern").endswith("/*").alias("open"), stem(F.col("base")).alias("base"))
    probed = imports.select("src", "module", F.explode(prefixes).alias("prefix")).join(known, "prefix").where("open OR prefix = module")
    rest = F.expr("substring(module, length(prefix) + 2)")
    best = probed.groupBy("src", "module").agg(F.max_by(F.struct("base", rest.alias("rest")), F.struct(F.length("prefix"), "base")).alias("b"))
    return best.select("src", "module", F.concat_ws("/", "b.base", F.nullif(F.col("b.rest"), F.lit(""))).alias("path"))


def module_files(module: Column, lang: Column) -> Column:
    """Files that may hold a module, by the language of what imports it; relative modules have none."""
    base = F.replace(module, F.lit("."), F.lit("/"))
    files = lambda *ends: F.array(*[F.concat(base, F.lit(e)) for e in ends])
    script = files(".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
    found = F.when(lang == "python", files(".py", "/__init__.py")).when(lang.isin("javascript", "typescript", "tsx"), script)
    return F.when(~module.rlike(r"^(relative::|[./@])|\.\*$") & (module != ""), found).otherwise(F.array().cast("array<string>"))


def resolved_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence, resolved_from): imports of outer modules that stand for exactly one known file of (path)."""
    asked = edges.where("relation = 'IMPORTS' AND src LIKE 'file:%' AND dst LIKE 'external::%'").select("src", F.expr("substring(dst, 11)").alias("module"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"))
    own = F.expr("substring(src, 6)")
    probed = asked.withColumn("path", F.explode(module_files(F.col("module"), language(own))))
    hits = probed.join(files.select("path").distinct(), "path").groupBy("src", "module").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path"), F.max("confidence").alias("confidence"))
    kept = hits.where("n = 1").select("src", file_node(F.col("path")).alias("dst"), F.lit("IMPORTS").alias("relation"), F.round(F.least(F.lit(0.98), F.col("confidence") + 0.1), 6).alias("confidence"), F.concat(F.lit("external::"), "module").alias("resolved_from"))
    known = edges.where("relation = 'IMPORTS'").select("src", "dst")
    return kept.where("src <> dst").join(known, ["src", "dst"], "left_anti")


def _external_module(dst: Column) -> Column:
    """The module of ``external::module`` or ``repo::external::module``, null for other ids."""
    return F.when(dst.startswith("external::"), F.expr("substring(dst, 11)")).when(F.contains(dst, F.lit("::external::")), F.regexp_extract(dst, r"(?s)^.*?::external::(.*)$", 1))


def cross_repo_imports(nodes: DataFrame, edges: DataFrame, hints: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence, resolved_from, hint_prefix): imports of outer modules that stand for one file or class of another repository.

    ``nodes``: (id, repo, language) of merged repositories; ``hints``: (prefix, repo), of which the longest that a module starts with, by
    whole segments, names the repository; it must be one of the graph and not the import's own. The file is the only one there among
    those that the module may stand for; failing that, the class is the only one there of the module's last name. Of several
    imports that lead to one target the first by module counts.
    """
    of_nodes = nodes.select("id", F.nullif(F.trim("repo"), F.lit("")).alias("repo"), F.coalesce("language", F.lit("mixed")).alias("told"))
    asked = edges.where("relation = 'IMPORTS'").select("src", "dst", F.coalesce("confidence", F.lit(0.75)).alias("confidence"), _external_module(F.col("dst")).alias("module"))
    asked = asked.where("module IS NOT NULL AND module <> '' AND module <> '*' AND NOT startswith(module, 'relative::') AND NOT endswith(module, '.*') AND NOT contains(module, '::*')")
    own = asked.join(of_nodes.where("repo IS NOT NULL"), F.col("src") == F.col("id")).drop("id")
    parts = F.split("module", r"\.")
    probed = own.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))))
    known = hints.select(F.trim("prefix").alias("prefix"), F.trim(F.col("repo")).alias("target")).where("prefix <> '' AND target <> ''")
    hit = probed.join(known, "prefix").groupBy("src", "dst", "module", "repo", "told").agg(F.max("confidence").alias("confidence"), F.max_by(F.struct("prefix", "target"), F.struct(F.length("prefix"), "target")).alias("h"))
    led = hit.select("src", "dst", "module", "told", "confidence", "h.prefix", "h.target", "repo").where("target <> repo").drop("repo")
    led = led.join(of_nodes.select(F.col("repo").alias("target")).where("target IS NOT NULL").distinct(), "target", "left_semi")

    path = F.regexp_extract("src", "(?s)::file:(.*)$", 1)
    lang = F.when(path != "", language(path)).otherwise(F.col("told"))
    java = (lang == "java") | (lang == "mixed") & F.contains("module", F.lit(".")) & ~F.contains("module", F.lit("/")) & ~F.endswith("module", F.lit(".py"))
    base = F.replace(F.substring_index("module", "$", 1), F.lit("."), F.lit("/"))
    outer = F.when(java, F.array(F.concat(base, F.lit(".java")), F.concat(base, F.lit(".kt")))).otherwise(F.array().cast("array<string>"))
    plain = lambda column: F.coalesce(column, F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(outer, plain(module_files(F.col("module"), F.when(lang == "mixed", "python").otherwise(lang))), plain(module_files(F.col("module"), F.lit("typescript")))))
    files = nodes.where("contains(id, '::file:')").select(F.col("id").alias("found"), F.substring_index("id", "::file:", 1).alias("target"), F.replace(F.regexp_extract("id", "(?s)^.*?::file:(.*)$", 1), F.lit("\\"), F.lit("/")).alias("path"))
    keys = ["src", "dst"]
    by_file = led.withColumn("path", F.explode(every)).join(files, ["target", "path"]).groupBy(*keys).agg(F.countDistinct("found").alias("n"), F.min("found").alias("found")).where("n = 1").drop("n")
    # A class is asked for by its last name where no single file was found.
    simple = F.when(~F.contains("module", F.lit("/")) & ~F.startswith("module", F.lit("@")) & F.contains("module", F.lit(".")), F.substring_index("module", ".", -1))
    classes = nodes.where("id LIKE '%::class:%'").select(F.col("id").alias("class"), F.substring_index("id", "::class:", 1).alias("target"), F.substring_index("id", "::", -1).alias("simple")).distinct()
    rest = led.join(by_file, keys, "left_anti").withColumn("simple", simple).join(classes, ["target", "simple"])
    by_class = rest.groupBy(*keys).agg(F.count("*").alias("n"), F.min("class").alias("found")).where("n = 1").drop("n")
    ends = led.join(by_file.unionByName(by_class), keys).groupBy("src", "found").agg(F.min_by(F.struct("confidence", "dst", "prefix"), F.struct("module", "dst")).alias("e"))
    told = F.round(F.least(F.lit(0.95), F.col("e.confidence") + 0.05), 6)
    return ends.select("src", F.col("found").alias("dst"), F.lit("CROSS_REPO_IMPORT").alias("relation"), told.alias("confidence"), F.col("e.dst").alias("resolved_from"), F.col("e.prefix").alias("hint_prefix"))


def in_repo(frame: DataFrame, repo: str, columns: list[str]) -> DataFrame:
    """``frame`` with ids written ``repo::id``, where they aren't yet, and the repo's name."""
    own = lambda c: F.when(F.col(c).startswith(repo + "::"), F.col(c)).otherwise(F.concat(F.lit(repo + "::"), c))
    return frame.withColumns({c: own(c) for c in columns} | {"repo": F.lit(repo)})


def merged_repos(repos: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several repos as one graph of disjoint parts."""
    parts = [(in_repo(nodes, name, ["id"]), in_repo(edges, name, ["src", "dst"])) for name, (nodes, edges) in repos.items()]
    nodes, edges = parts[0]
    for more_nodes, more_edges in parts[1:]:
        nodes, edges = nodes.unionByName(more_nodes, allowMissingColumns=True), edges.unionByName(more_edges, allowMissingColumns=True)
    return nodes, edges


# Building and exporting


def stable_schema(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, name, file_path) and edges (src, dst, relation, confidence) with files and classes derived from their symbols.

    A file contains its classes, a class its methods; equal edges are one, and an asynchronous call has a twin of relation ASYNC.
    """
    owned = symbols.where("file_path <> ''")
    class_id = F.concat(F.lit("class:"), "file_path", F.lit("::"), "class_name")
    files = owned.select(file_node(F.col("file_path")).alias("id"), F.lit("File").alias("kind"), F.substring_index("file_path", "/", -1).alias("name"), "file_path").distinct()
    classes = owned.where("class_name IS NOT NULL").select(class_id.alias("id"), F.lit("Class").alias("kind"), F.substring_index("class_name", ".", -1).alias("name"), "file_path").distinct()
    methods = symbols.where("NOT id RLIKE '^(file|class|external):'").select("id", F.initcap("kind").alias("kind"), F.coalesce("method_name", symbol_tail(F.col("id"))).alias("name"), "file_path")
    held = owned.where("class_name IS NOT NULL").select(file_node(F.col("file_path")).alias("src"), class_id.alias("dst"))
    held = held.unionByName(owned.select(F.coalesce(class_id, file_node(F.col("file_path"))).alias("src"), F.col("id").alias("dst")))
    contains = held.distinct().select("src", "dst", F.lit("CONTAINS").alias("relation"), F.lit(1.0).alias("confidence"))
    named = edges.withColumn("relation", F.coalesce("relation", F.lit("CALLS")))
    own = named.select("src", "dst", "relation", "confidence")
    twins = named.where("relation = 'CALLS' AND is_async").select("src", "dst", F.lit("ASYNC").alias("relation"), "confidence")
    every = contains.unionByName(own).unionByName(twins).groupBy("src", "dst", "relation").agg(F.max("confidence").alias("confidence"))
    return files.unionByName(classes).unionByName(methods), every


def community_labels(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, community, label, confidence, n_members) over members (community, node, file_path): kind of path, shared folder, and what its edges are.

    Communities are numbered in order of label and first member.
    """
    paths = members.where("file_path <> ''").select("community", "file_path").distinct()
    shared = graph.common_prefix(paths, "community", "file_path").select("community", F.col("prefix").alias("folder"))
    stats = graph.community_stats(edges, members.select("node", "community")).select("community", "n", "n_calls", "n_imports")
    sized = members.groupBy("community").agg(F.countDistinct("node").alias("n_members"), F.min("node").alias("first"), F.min(F.nullif(F.col("file_path"), F.lit(""))).alias("top"))
    full = sized.join(dominant_kind(paths, "community", "file_path").drop("n"), "community", "left").join(shared, "community", "left").join(stats, "community", "left")
    folder = F.nullif(F.col("folder"), F.lit(""))
    told = F.when(F.length(folder) <= 48, folder).otherwise(F.concat(F.substring(folder, 1, 45), F.lit("…")))
    place = F.coalesce(told, F.split_part("top", F.lit("/"), F.lit(1)), F.lit("mixed_symbols"))
    dense = F.when(F.col("n_calls") / F.col("n") >= 0.5, "call_dense").when(F.col("n_imports") / F.col("n") >= 0.5, "import_dense")
    signs = F.col("bucket").isNotNull().cast("int") + folder.isNotNull().cast("int")
    confidence = F.when(signs == 2, 0.75).when(signs == 1, 0.6).otherwise(0.45)
    labelled = full.select("community", F.concat_ws("/", "bucket", place, dense).alias("label"), confidence.alias("confidence"), "n_members", "first")
    # One row a community is left; its rank is all that this window holds.
    return labelled.withColumn("place", F.row_number().over(Window.orderBy("label", "first")) - 1).drop("first")


def label_sizes(labels: DataFrame, n: int = 15) -> DataFrame:
    """(label, n): members by label, the largest first."""
    return labels.groupBy("label").agg(F.sum("n_members").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def label_histogram(nodes: DataFrame, labels: str) -> DataFrame:
    """(label, n) of nodes with arrays of labels."""
    return nodes.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def topic_edges(lines: DataFrame, calls: DataFrame, listeners: DataFrame) -> DataFrame:
    """(src, dst, relation, role, confidence): producers from lines (file, line, text) that send to a topic, as of the last call (file, line, caller) before; consumers from listeners (symbol, topics), five topics each."""
    sent = lines.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(TOPIC), F.lit(1))).alias("topic"))
    both = sent.select("file", "line", "topic", F.lit(None).cast("string").alias("caller"), F.lit(1).alias("k")).unionByName(calls.select("file", "line", F.lit(None).cast("string").alias("topic"), "caller", F.lit(0).alias("k")))
    before = Window.partitionBy("file").orderBy("line", "k").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("caller", F.last("caller", ignorenulls=True).over(before)).where("k = 1 AND caller IS NOT NULL")
    topic = lambda c: F.when(F.col(c).startswith("topic:"), F.col(c)).otherwise(F.concat(F.lit("topic:"), c))
    produced = known.select(F.col("caller").alias("src"), topic("topic").alias("dst"), F.lit("EVENT").alias("relation"), F.lit("producer").alias("role"), F.lit(0.55).alias("confidence"))
    heard = listeners.select("symbol", F.explode(F.slice(F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.array(F.lit("unknown"))), 1, 5)).alias("topic"))
    consumed = heard.select(topic("topic").alias("src"), F.col("symbol").alias("dst"), F.lit("EVENT").alias("relation"), F.lit("consumer").alias("role"), F.lit(0.9).alias("confidence"))
    return produced.unionByName(consumed).distinct()


def flow_tree(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(path, node, depth, back_edge): the ways from a node, level by level; a node that is on its path already ends it."""
    step = cut(edges.select("src", "dst").distinct())
    front = edges.sparkSession.createDataFrame([([start], False)], "path array<string>, back_edge boolean")
    out = front
    for _ in range(depth):
        last = F.element_at("path", -1)
        longer = front.where("NOT back_edge").withColumn("at", last).join(step, F.col("at") == F.col("src"))
        front = cut(longer.select(F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("back_edge")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.select(F.array_join("path", ">").alias("path"), F.element_at("path", -1).alias("node"), (F.size("path") - 1).alias("depth"), "back_edge")


def dependency_bullets(edges: DataFrame, n: int = 20) -> DataFrame:
    """(node, place, line): the first ``n`` targets of each node as list items, by relation and target."""
    kept = edges.select(F.col("src").alias("node"), F.coalesce("relation", F.lit("CALLS")).alias("relation"), "dst").distinct()
    order = Window.partitionBy("node").orderBy("relation", "dst")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("node", "place", F.concat(F.lit("- `"), "dst", F.lit("` ("), "relation", F.lit(")")).alias("line"))


def event_chains(edges: DataFrame) -> DataFrame:
    """(producer, topic, consumer, line): who hears what a producer sends, topic by topic."""
    sent = edges.where("relation = 'EVENT' AND dst LIKE 'topic:%'").select(F.col("src").alias("producer"), F.col("dst").alias("topic"))
    heard = edges.where("relation = 'EVENT' AND src LIKE 'topic:%'").select(F.col("src").alias("topic"), F.col("dst").alias("consumer"))
    return sent.join(heard, "topic").distinct().select("producer", "topic", "consumer", F.concat(F.lit("- `"), "producer", F.lit("` → `"), "topic", F.lit("` → `"), "consumer", F.lit("`")).alias("line"))


def capped(nodes: DataFrame, edges: DataFrame, n_nodes: int, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id, and of the edges between them the first by relation and ends."""
    kept = nodes.orderBy("id").limit(n_nodes)
    inside = graph.induced(edges, kept.select(F.col("id").alias("node")))
    return kept, inside.orderBy("relation", "src", "dst").limit(n_edges)


# Questions


def pattern_query(nodes: DataFrame, edges: DataFrame, question: str, n: int = 5000) -> DataFrame:
    """Edges of ``MATCH (a)-[CALLS|IMPORTS]->(b) WHERE name = "x"``; ``*`` or nothing between the brackets is every relation.

    The condition holds if either end fulfils it: its name or method_name is the value, or its id is the value or ends with it.
    Another field sets no condition. Of equal edges each counts; the first ``n`` by source, target and relation are given.
    """
    asked = re.search(r"MATCH\s*\(\w+\)\s*-\[\s*([^\]]*?)\s*\]->\s*\(\w+\)", question or "", re.IGNORECASE | re.DOTALL)
    wanted = [r.strip() for r in (asked.group(1) if asked else "*").split("|") if r.strip()]
    found = edges.where(F.col("relation").isin(wanted)) if wanted and wanted != ["*"] else edges
    condition = re.search(r'WHERE\s+(\S+)\s*=\s*"([^"]*)"', question or "", re.IGNORECASE)
    field, value = (condition.group(1).lower(), condition.group(2).strip()) if condition else ("", "")
    if field == "name":
        ids = nodes.where((F.col("name") == value) | (F.col("method_name") == value)).select("id")
        hit = ids.distinct().withColumn("hit", F.lit(True))
        found = found.join(hit.withColumnsRenamed({"id": "src", "hit": "at_src"}), "src", "left").join(hit.withColumnsRenamed({"id": "dst", "hit": "at_dst"}), "dst", "left").where("at_src OR at_dst")
    elif field in ("id", "nid"):
        found = found.where(F.col("src").endswith(value) | F.col("dst").endswith(value))
    return found.select("src", "dst", "relation").orderBy("src", "dst", "relation").limit(n)


def intent(question: Column) -> Column:
    """What a question in words asks for; ``unknown`` if no word tells."""
    low = F.concat(F.lit(" "), F.lower(question), F.lit(" "))
    out = F.lit("unknown")
    for name, words in reversed(INTENTS):
        found = F.lit(False)
        for word in words:
            found = found | F.contains(low, F.lit(word))
        if name == "event_flow":
            found = found | (F.contains(low, F.lit("async")) & F.contains(low, F.lit("call")))
        out = F.when(found, name).otherwise(out)
    return out


#: Intents that are about a symbol.
ABOUT_SYMBOLS = ("called_by", "impact", "references")
# Where a question names its symbol, in the order in which they count, and words that are no names.
HINTS = (r"(?i)for\s+`([^`]+)`", r"(?i)for\s+['\"]([^'\"]+)['\"]", r"(?i)for\s+([\w.]+(?:\s*::\s*[\w.]+)?)", r"(?i)by\s+`([^`]+)`", r"(?i)by\s+['\"]([^'\"]+)['\"]", r"(?i)by\s+([\w.]+)")
NO_NAMES = ("the", "a", "an", "for", "to", "of", "in", "on", "by", "is", "are", "what", "which", "who", "how", "find", "show", "list", "get", "me", "methods", "method", "flows", "flow", "calls", "call")


def target_hint(question: Column) -> Column:
    """The name that a question is about: what follows ``for`` or ``by``, or else stands last in back quotes, or else is its last word that may be a name."""
    said = [F.nullif(F.trim(F.regexp_extract(question, p, 1)), F.lit("")) for p in HINTS]
    quoted = F.trim(F.try_element_at(F.regexp_extract_all(question, F.lit("`([^`]+)`"), F.lit(1)), F.lit(-1)))
    words = F.filter(F.regexp_extract_all(question, F.lit(r"(?U)[\w.]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*NO_NAMES) & (F.length(w) > 1))
    return F.coalesce(*said, quoted, F.try_element_at(words, F.lit(-1)))


def resolved_hints(hints: DataFrame, symbols: DataFrame, n: int = 50) -> DataFrame:
    """(question, node, n_candidates): the symbol that a hint (question, hint) names; node is null where none or several fit.

    A symbol fits by its method's name, its tail or its whole id; parts of ids are exploded and joined by equality.
    """
    parts = F.array_distinct(F.array(F.lower("id"), F.lower(symbol_tail(F.col("id"))), F.lower(F.substring_index(F.col("id"), ".", -1)), F.lower(F.coalesce("method_name", F.lit("")))))
    named = symbols.select("id", F.explode(parts).alias("part"))
    fits = hints.join(named, F.lower("hint") == F.col("part")).groupBy("question").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    return hints.join(fits, "question", "left").select("question", F.when(F.col("n") == 1, F.col("id")).alias("node"), F.least(F.coalesce("n", F.lit(0)), F.lit(n)).alias("n_candidates"))


def top_impacted(edges: DataFrame, seeds: DataFrame, candidates: int = 300, n: int = 10) -> DataFrame:
    """(seed, n_reached): of the first ``candidates`` seeds by degree, those that reach most nodes."""
    degree = graph.top_degree(edges, candidates, seeds)
    # The candidates are few by their limit.
    reached = graph.reach_counts(edges, [r["node"] for r in degree.select("node").collect()])
    rows = sorted(((seed, count) for seed, count in reached.items() if count), key=lambda r: (-r[1], r[0]))
    return edges.sparkSession.createDataFrame(rows[:n], "seed string, n_reached long")
