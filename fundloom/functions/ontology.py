"""The ontology as fixed values, and functions over it: labels, relations, grounding in classes, CURIEs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default class of each label, property types and their class, hints of a debt issuer and its class.
LABEL_CLASS = {
    "Company": "cmns-org:LegalEntity", "Fund": "fibo-sec-sec-pls:CollectiveInvestmentVehicle", "Portfolio": "fibo-sec-sec-pls:CollectiveInvestmentVehicle",
    "RealProperty": "fibo-fnd-plc-rp:RealProperty", "Loan": "fibo-loan-ln-ln:Loan", "Valuation": "fibo-fnd-plc-rp:RealPropertyAppraisal", "Lease": "fibo-fnd-agr-ctr:Contract",
}
PROPERTY_TYPES = ["office", "commercial office", "class a office", "office collateral", "logistics", "logistics center", "industrial"]
PROPERTY_CLASS = "fibo-fnd-plc-rp:RealProperty"
ISSUER_HINTS = ["bond issuer", "debt issuer", "corporate debt", "note issuer", "debt capital"]
DEBT_ISSUER = "fibo-sec-dbt-dbt:CorporateDebtIssuer"


def ground_class(label: Column, category: Column, attributes: Column) -> Column:
    """The CURIE of an entity's class, or null: a debt issuer is more than a legal entity, property types map to one class."""
    attr = lambda k: F.try_element_at(attributes, F.lit(k))
    hint = F.lower(F.concat_ws(" ", category, attr("role"), attr("issuer_type"), attr("kind")))
    issuer = F.lit(False)
    for h in ISSUER_HINTS:
        issuer = issuer | hint.contains(h)
    kind = F.lower(F.trim(F.coalesce(attr("property_type"), category, F.lit(""))))
    default = F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in LABEL_CLASS.items()])
    return F.when((label == "Company") & issuer, DEBT_ISSUER).when((label == "RealProperty") & kind.isin(PROPERTY_TYPES), PROPERTY_CLASS).otherwise(default)


def iri_of(curie: Column, prefixes: dict[str, str]) -> Column:
    """The full IRI; a CURIE of no known prefix stays."""
    prefix, local = F.split_part(curie, F.lit(":"), F.lit(1)), F.regexp_replace(curie, "^[^:]*:?", "")
    base = F.coalesce(*[F.when((prefix == p) & curie.contains(":"), F.lit(b)) for p, b in prefixes.items()])
    return F.when(base.isNotNull(), F.concat(base, local)).otherwise(curie)


def curie_of(iri: Column, prefixes: dict[str, str]) -> Column:
    """The CURIE by the longest base that fits; else the IRI."""
    longest = sorted(prefixes.items(), key=lambda x: -len(x[1]))
    return F.coalesce(*[F.when(F.startswith(iri, F.lit(b)), F.concat(F.lit(f"{p}:"), F.substr(iri, F.lit(len(b) + 1)))) for p, b in longest], iri)


def infer_label(known: Column, allowed: Column) -> Column:
    """A relation's end is what it is known as if that is allowed, else the first label that is."""
    return F.when(F.array_contains(allowed, known), known).otherwise(F.get(allowed, F.lit(0)))


def pairs_to_map(pairs: Column) -> Column:
    """``array<struct<key, value>>`` as a map, the last value of a repeated key; null keys left out."""
    some = F.filter(pairs, lambda x: x["key"].isNotNull())
    keys = F.array_distinct(F.transform(some, lambda x: x["key"]))
    last = lambda k: F.element_at(F.filter(some, lambda x: x["key"] == k), -1)["value"]
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, last(k))))


def sorted_text(m: Column) -> Column:
    """A map as ``key=value`` text in the order of its keys; a canonical form."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("null")))), ";")


def clamped(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def cited(*fields: str) -> Column:
    """The fields that are there, as ``name=value`` text."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in fields])


def entity_props(attributes: Column, allowed: list[str], cik: Column, curie: Column) -> Column:
    """The attributes that the label knows and that say something, the resolved id, and what grounding found."""
    own = F.map_filter(attributes, lambda k, v: k.isin(allowed) & v.isNotNull() & (v != ""))
    grounded = F.when(curie.isNotNull(), F.lit("true"))
    more = F.create_map(F.lit("cik"), cik, F.lit("fibo_class"), curie, F.lit("fibo_grounded"), grounded, F.lit("reasoning_valid"), grounded)
    return F.map_concat(own, F.map_filter(more, lambda _, v: v.isNotNull()))
