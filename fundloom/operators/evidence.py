"""What an answer is built from: chunks in scope, evidence for names, citations, views of documents and paths.

chunks: chunk_id, doc_id, page, text, sensitivity. mentions: chunk_id, company. stamped: doc_id of documents that carry a firm's stamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.operators.scope import graph_visible, text_visible
from fundloom.operators.traversal import links, reach_min_hops, top_chokepoints
from fundloom.sources.tables import written


def firm_scope_chunks(chunks: DataFrame, mentions: DataFrame, held: DataFrame | None, stamped: DataFrame) -> DataFrame:
    """Chunks that mention a held issuer or belong to a stamped document: two equi-joins, not one OR; without a firm, all."""
    if held is None:
        return chunks
    by_mention = mentions.join(held, "company", "left_semi").select("chunk_id")
    by_stamp = chunks.join(stamped.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id")
    return chunks.join(by_mention.unionByName(by_stamp).distinct(), "chunk_id", "left_semi")


def firm_has_chunks(firm_chunks: DataFrame, firms: DataFrame) -> DataFrame:
    """firm, has_chunks. firm_chunks: firm, chunk_id."""
    return firms.select("firm").join(firm_chunks.select(F.col("firm").alias("f")).distinct(), F.col("firm") == F.col("f"), "left").select("firm", F.col("f").isNotNull().alias("has_chunks"))


def evidence_chunks(names: DataFrame, chunks: DataFrame, mentions: DataFrame, document: DataFrame, entitlements: list[str]) -> DataFrame:
    """query, chunk_id, doc_id, title, visible: chunks that mention any of a query's names, each once. names: query, company."""
    met = names.select("query", "company").distinct().join(mentions, "company").select("query", "chunk_id").distinct()
    told = met.join(chunks.select("chunk_id", "doc_id", "sensitivity"), "chunk_id").join(document.select("doc_id", "title"), "doc_id", "left")
    return told.select("query", "chunk_id", "doc_id", "title", text_visible(F.col("sensitivity"), entitlements).alias("visible"))


def citation_union(evidence: DataFrame, by_vector: DataFrame) -> DataFrame:
    """query, chunk_id, kind: evidence, then nearest chunks that are not among it."""
    both = evidence.select("query", "chunk_id", F.lit(0).alias("k")).unionByName(by_vector.select("query", "chunk_id", F.lit(1).alias("k")))
    return both.groupBy("query", "chunk_id").agg(F.min("k").alias("k")).select("query", "chunk_id", F.when(F.col("k") == 0, "evidence").otherwise("vector").alias("kind"))


def entity_union(detected: DataFrame, results: DataFrame) -> DataFrame:
    """query, entity: names found in a question, and those its analytics result is about."""
    return detected.select("query", "entity").union(results.select("query", "entity")).where("entity is not null").distinct()


def vocab_union(names: DataFrame) -> DataFrame:
    """alias, canonical: lower-case names and tickers; of rows with the same alias the last (by ord, a ticker after the name) stays.

    names: ord, name, ticker."""
    by_name = names.select(F.lower("name").alias("alias"), F.col("name").alias("canonical"), F.struct("ord", F.lit(0).alias("k")).alias("at"))
    by_ticker = names.select(F.lower("ticker").alias("alias"), F.col("name").alias("canonical"), F.struct("ord", F.lit(1).alias("k")).alias("at"))
    both = by_name.unionByName(by_ticker).where("alias is not null and alias <> '' and canonical is not null")
    return both.groupBy("alias").agg(F.max_by("canonical", "at").alias("canonical"))


def documents_view(document: DataFrame, chunks: DataFrame, entitlements: list[str]) -> DataFrame:
    """doc_id, title, n_spans, text: visible documents with their chunks' texts in the order of pages, empty ones skipped."""
    seen = document.where(graph_visible(F.col("sensitivity"), entitlements))
    parts = chunks.where("text is not null and text <> ''").groupBy(F.col("doc_id").alias("d")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit("0")).alias("page"), "chunk_id", "text"))).alias("parts"))
    told = seen.join(parts, F.col("doc_id") == F.col("d"), "left")
    return told.select("doc_id", "title", F.coalesce(F.size("parts"), F.lit(0)).alias("n_spans"), F.coalesce(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"), F.lit("")).alias("text"))


def node_label(*props: str, kind: str) -> Column:
    """A node's display label: the first of its properties that is there, else its type."""
    return F.coalesce(*props, F.lit(kind))


def strip_embedding(props: Column) -> Column:
    return F.map_filter(props, lambda k, _: k != "embedding")


def edge_limit(edges: DataFrame, most: int = 300) -> DataFrame:
    """At most ``most`` (1 to 2000) edges, the first in order: what a screen shows of a subgraph."""
    return edges.orderBy("rel", "src", "dst").limit(max(1, min(most, 2000)))


def analytics_in_firm(results: DataFrame, held: DataFrame) -> DataFrame:
    """Results (result, entities) about an issuer that the firm holds; one about nothing in particular stays."""
    each = results.select("result", F.explode("entities").alias("company")).join(held, "company", "left_semi").select("result").distinct()
    return results.join(each, "result", "left_semi").unionByName(results.where(F.size("entities") == 0))


def post_filtered(nearest: DataFrame, chunks: DataFrame, entitlements: list[str], scope: DataFrame | None = None) -> DataFrame:
    """The nearest chunks that a reader may see, which may be fewer than were asked for. nearest: query, chunk_id, rank."""
    seen = chunks.where(text_visible(F.col("sensitivity"), entitlements)).select("chunk_id")
    seen = seen if scope is None else seen.join(scope.select("chunk_id"), "chunk_id", "left_semi")
    return nearest.join(seen, "chunk_id", "left_semi")


def said_step(start, rel, end, detail=None) -> Column:
    """One step of a path as text; a detail stands in brackets."""
    text = lambda x: F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    plain = F.concat_ws("-", text(start), rel if isinstance(rel, Column) else F.lit(rel), text(end))
    return plain if detail is None else F.concat(plain, F.lit("["), detail, F.lit("]"))


def in_order(step: Column) -> Column:
    return F.array_sort(F.collect_set(step))


def chokepoint_paths(holds: DataFrame, supplies_to: DataFrame) -> DataFrame:
    """fund, label, steps: a path from each holding that reaches, within two hops, the node that most of the fund's holdings reach and that it doesn't
    hold (ties: the smaller id)."""
    holds, step = written(holds.select("fund", "company").distinct(), "chokepoint-holdings"), written(links(supplies_to), "chokepoint-steps")
    top = written(top_chokepoints(holds, step), "chokepoint-tops")
    # Back from these few nodes.
    back = reach_min_hops(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")), top.select(F.col("node").alias("company"))).select("seed", F.col("node").alias("from"))
    own = holds.join(top.select(F.col("fund").alias("f"), "node"), F.col("fund") == F.col("f"))
    told = own.join(back, (F.col("node") == F.col("seed")) & (F.col("company") == F.col("from")), "left_semi")
    label = F.concat(F.col("company").cast("string"), F.lit(" → … → "), F.col("node").cast("string"))
    return told.select("fund", label.alias("label"), said_step("company", "SUPPLIES_TO*1..2", "node").alias("steps"))


def coverage_gap_paths(holds: DataFrame, exposed_to: DataFrame, risk_factor: DataFrame, covers: DataFrame) -> DataFrame:
    """fund, label, steps: for each risk of a fund's holdings that no section covers, a step from each exposed holding, in order of names, and the missing one."""
    gaps = holds.select("fund", "company").join(exposed_to.select("company", "risk_title"), "company").join(covers.select("risk_title"), "risk_title", "left_anti")
    told = gaps.join(risk_factor.select(F.col("title").alias("risk_title"), F.coalesce("category", F.lit("")).alias("category")), "risk_title")
    steps = told.groupBy("fund", "risk_title").agg(in_order(said_step("company", "EXPOSED_TO", "risk_title", F.col("category"))).alias("steps"))
    last = F.array(said_step(F.lit("prospectus (485BPOS)"), "COVERS?", "risk_title", F.lit("MISSING")))
    return steps.select("fund", F.concat(F.lit("Uncovered: "), "risk_title").alias("label"), F.array_join(F.concat("steps", last), "|").alias("steps"))


def board_paths(links: DataFrame) -> DataFrame:
    """company, label, steps: for each director or officer of a company the role there, then those elsewhere. links: company, person, role, other, other_role."""
    elsewhere = F.when(F.col("other").isNotNull(), said_step("person", F.coalesce("other_role", F.lit("LINK")), "other"))
    told = links.groupBy("company", "person", "role").agg(in_order(elsewhere).alias("others"))
    steps = F.array_join(F.concat(F.array(said_step("person", F.col("role"), "company")), "others"), "|")
    return told.select("company", F.concat(F.col("person").cast("string"), F.lit(" interlocks/alumni")).alias("label"), steps.alias("steps"))


def exposure_steps(paths: DataFrame) -> DataFrame:
    """label, steps of each path. paths: path (ids between ``>``), labels (of the edges, between ``>``)."""
    nodes, labels = F.split("path", ">"), F.split("labels", ">")
    each = F.transform(F.sequence(F.lit(0), F.size(nodes) - 2), lambda i: F.concat(F.get(nodes, i), F.lit("-SUPPLIES_TO-"), F.get(nodes, i + 1), F.coalesce(F.concat(F.lit("["), F.get(labels, i), F.lit("]")), F.lit(""))))
    return paths.where(F.size(nodes) > 1).select(F.concat(F.get(nodes, F.lit(0)), F.lit(" → "), F.element_at(nodes, -1)).alias("label"), F.array_join(each, "|").alias("steps"))


def shared_supplier_paths(holds: DataFrame, supplies_to: DataFrame) -> DataFrame:
    """fund, label, steps: the path from a fund over each holding to its most shared critical supplier (ties: the smaller id)."""
    edges = holds.select("fund", "company").join(supplies_to.where("criticality = 'critical'"), F.col("company") == F.col("src")).select("fund", "company", F.col("dst").alias("supplier")).distinct()
    most = edges.groupBy("fund", "supplier").agg(F.count("*").alias("n")).groupBy("fund").agg(F.min_by("supplier", F.struct((-F.col("n")).alias("n"), "supplier")).alias("top"))
    said = lambda *c: F.concat(*[F.col(x).cast("string") if isinstance(x, str) else x for x in c])
    arrow = F.lit(" → ")
    steps = F.array(F.struct(F.col("fund").cast("string").alias("from"), F.lit("HOLDS").alias("rel"), F.col("company").cast("string").alias("to")), F.struct(F.col("company").cast("string").alias("from"), F.lit("SUPPLIES_TO").alias("rel"), F.col("supplier").cast("string").alias("to")))
    told = edges.join(most.withColumnRenamed("fund", "f"), (F.col("fund") == F.col("f")) & (F.col("supplier") == F.col("top")))
    return told.select("fund", said("fund", arrow, "company", arrow, "supplier").alias("label"), F.array_join(F.transform(steps, lambda s: F.concat_ws("-", s["from"], s["rel"], s["to"])), "|").alias("steps"))
