"""The field schema: declaration, JSON Schema, coercion, coverage, provenance, recipes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import normalize

#: Spark and JSON Schema types of each field type.
KINDS = {"string": ("string", "string"), "number": ("double", "number"), "money": ("struct<amount:decimal(18,2),currency:string>", "object"), "date": ("string", "string"), "url": ("string", "string"), "email": ("string", "string"), "phone": ("string", "string"), "bool": ("boolean", "boolean"), "enum": ("string", "string")}
#: Schema.org property names that stand for a field.
SYNONYMS = {"title": ["name", "headline"], "name": ["title", "headline"], "price": ["offers.price", "lowPrice"], "brand": ["brand.name", "manufacturer"], "author": ["author.name", "creator"], "date": ["datePublished", "dateCreated", "uploadDate"], "image": ["image", "thumbnailUrl"], "description": ["abstract"], "rating": ["aggregateRating.ratingValue"]}
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    required: bool = False
    values: tuple = ()
    fields: tuple = field(default=())
    many: bool = False

    def spark_type(self) -> T.DataType:
        if self.fields:
            own = T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields])
        else:
            own = T._parse_datatype_string(KINDS[self.kind][0])
        return T.ArrayType(own) if self.many else own

    def json_schema(self) -> dict:
        if self.fields:
            own = {"type": "object", "properties": {f.name: f.json_schema() for f in self.fields}}
            if needed := [f.name for f in self.fields if f.required]:
                own["required"] = needed
        else:
            own = {"type": KINDS[self.kind][1]}
            own |= {"enum": list(self.values)} if self.kind == "enum" else {"format": {"date": "date", "url": "uri", "email": "email"}[self.kind]} if self.kind in ("date", "url", "email") else {}
        return {"type": "array", "items": own} if self.many else own


def to_json_schema(fields: list[Field]) -> dict:
    return {"$schema": "http://json-schema.org/draft-07/schema#", **Field("", fields=tuple(fields)).json_schema()}


def schema_hash(fields: list[Field]) -> str:
    return hashlib.sha256(json.dumps(to_json_schema(fields), sort_keys=True).encode()).hexdigest()


def coerced(value: Column, f: Field) -> Column:
    """A string as the field's type, null where it can't be one."""
    if f.kind == "number":
        return normalize.number(value)
    if f.kind == "money":
        return normalize.money(value)
    if f.kind == "date":
        return normalize.date(value)
    if f.kind == "phone":
        return normalize.phone(value)
    if f.kind == "bool":
        low = F.lower(F.btrim(value))
        return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)
    checks = {"email": F.regexp_like(value, F.lit(EMAIL)), "url": F.regexp_like(value, F.lit(r"^https?://[^/\s]+")), "enum": value.isin(*f.values) if f.values else F.lit(False)}
    return F.when(checks[f.kind], value) if f.kind in checks else value


def validated(df: DataFrame, fields: list[Field]) -> DataFrame:
    """df with its string fields coerced and errors (array<string>: fields missing or not of their type)."""
    errors = [F.when(F.col(f.name).isNotNull() & coerced(F.col(f.name), f).isNull(), F.lit(f"{f.name}: not a {f.kind}")).when(F.col(f.name).isNull() & F.lit(f.required), F.lit(f"{f.name}: missing")) for f in fields]
    own = df.withColumn("errors", F.array_compact(F.array(*errors)))
    return own.withColumns({f.name: coerced(F.col(f.name), f) for f in fields})


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, satisfied, missing) over all rows."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count(F.col(f)).alias(f) for f in fields))
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("satisfied"), (F.col("_n") - F.col(f)).alias("missing")) for f in fields)))
    return counts.select(one.alias("x")).select("x.*")


def from_json_ld(json_ld: Column, name: str) -> Column:
    """A field of the first JSON-LD object that has it, under its own name or a synonym; @graph members count as objects."""
    every = F.flatten(F.transform(json_ld, lambda j: F.concat(F.array(j), F.coalesce(F.from_json(F.get_json_object(j, "$['@graph']"), "array<string>"), F.array().cast("array<string>")))))
    names = [name, *SYNONYMS.get(name, [])]
    found = F.transform(every, lambda j: F.coalesce(*(F.get_json_object(j, f"$.{n}") for n in names)))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def with_provenance(sources: list[tuple[str, Column, float]]) -> Column:
    """struct<value, source, confidence> of the first source that has a value: deterministic ones come before a model."""
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(name).alias("source"), F.lit(sure).alias("confidence"))) for name, c, sure in sources))


def recipe_key(host: Column, fields: list[Field]) -> Column:
    return F.concat_ws("|", F.lower(host), F.lit(schema_hash(fields)))


def recipes_for(pages: DataFrame, recipes: DataFrame, fields: list[Field], max_age_days: int | None = None) -> DataFrame:
    """pages (host) with the recipe of their host for these fields, of recipes (host, schema_hash, version, created,
    recipe): the highest version, null where there is none or it is older than max_age_days."""
    own = recipes.where(F.col("schema_hash") == schema_hash(fields))
    if max_age_days is not None:
        own = own.where(F.date_diff(F.current_date(), F.col("created").cast("date")) <= max_age_days)
    newest = own.groupBy(F.lower("host").alias("_host")).agg(F.max_by("recipe", "version").alias("recipe"), F.max("version").alias("version"))
    return pages.join(newest, F.lower(pages["host"]) == F.col("_host"), "left").drop("_host")


#: Words of a request that name a field, and the field's type.
ASKED = {"title": "string", "name": "string", "price": "money", "date": "date", "author": "string", "email": "email", "phone": "phone", "link": "url", "url": "url", "image": "url", "rating": "number", "quantity": "number", "description": "string", "address": "string", "brand": "string"}


def planned(request: Column, reply: Column | None = None) -> Column:
    """struct<many, fields array<struct<name, kind>>> of a request in words: a model's reply (JSON of that struct) where
    it is one with fields, else by rules: each word of ASKED, singular or plural, is a field, in order and once; a list is
    wanted where the words all, every, each or list occur, or a plural of a field."""
    shape = "struct<many:boolean,fields:array<struct<name:string,kind:string>>>"
    kinds = F.create_map(*(F.lit(x) for pair in ASKED.items() for x in pair))
    words = F.filter(F.split(F.lower(F.coalesce(request, F.lit(""))), "[^a-z]+"), lambda w: w != "")
    single = lambda w: F.when(F.endswith(w, F.lit("s")), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    named = F.array_distinct(F.filter(F.transform(words, single), lambda w: F.map_contains_key(kinds, w)))
    many = F.exists(words, lambda w: w.isin("all", "every", "each", "list") | (F.endswith(w, F.lit("s")) & F.map_contains_key(kinds, single(w))))
    ruled = F.struct(many.alias("many"), F.transform(named, lambda w: F.struct(w.alias("name"), F.element_at(kinds, w).alias("kind"))).alias("fields"))
    if reply is None:
        return ruled
    told = F.from_json(reply, shape)
    return F.when(F.size(F.coalesce(told["fields"], F.array().cast("array<struct<name:string,kind:string>>"))) > 0, F.struct(F.coalesce(told["many"], F.lit(False)).alias("many"), told["fields"].alias("fields"))).otherwise(ruled)


def run_recipes(matches: DataFrame, recipes: DataFrame, policy: str = "resynthesize", max_age_days: int = 30) -> DataFrame:
    """matches (host, url, selector_matches) with each recipe's fields (host, field, selector, created): the first match
    of the selector, n_matches, and action: keep, expired, or the policy (resynthesize, fallback_to_ai, fail) where the
    selector finds nothing."""
    both = matches.join(recipes, "host")
    found = F.coalesce(F.try_element_at("selector_matches", F.col("selector")), F.array().cast("array<string>"))
    out = both.withColumns({"value": F.get(found, F.lit(0)), "n_matches": F.size(found)})
    old = F.date_diff(F.current_date(), F.col("created").cast("date")) > max_age_days
    return out.withColumn("action", F.when(F.col("n_matches") == 0, F.lit(policy)).when(old, F.lit("expired")).otherwise(F.lit("keep")))


def drift(ran: DataFrame) -> DataFrame:
    """(host, field, pages, empty, drifted): a recipe field has drifted if no page of its host matches."""
    out = ran.groupBy("host", "field").agg(F.count("*").alias("pages"), F.count_if(F.col("n_matches") == 0).alias("empty"))
    return out.withColumn("drifted", F.col("pages") == F.col("empty"))


def verified(recipe_values: DataFrame, ai_values: DataFrame, key: str) -> DataFrame:
    """(host, accepted): recipes whose every value equals the model's, nulls alike."""
    both = recipe_values.alias("r").join(ai_values.alias("a"), [key, "field"])
    return both.groupBy("r.host").agg(F.bool_and(F.col("r.value").eqNullSafe(F.col("a.value"))).alias("accepted"))
