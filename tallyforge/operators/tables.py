"""Rolled-up tables: flattening, canonical JSON, manifests, schema rules, idempotence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nullable whole numbers and flags of the rolled-up tables.
INT_COLUMNS = ("rep", "seq", "probe_idx", "first_exposure_seq", "first_used_seq", "first_mention_probe", "last_mention_probe", "n_probes_observed", "at_risk_horizon", "lapse_probe_index", "criteria_total", "criteria_graded", "criteria_errored", "tokens_input", "tokens_output")
BOOL_COLUMNS = ("available", "read", "read_inbound_only", "opened", "used", "eligible", "ever_mention", "analyzable", "quarantined", "success", "parse_ok", "fidelity_agree")


def canonical_json(value: Column) -> Column:
    """Keys in order and nothing between; an empty or null value is null."""
    text = F.to_json(F.variant_get(F.parse_json(F.to_json(value)), F.lit("$"), "variant"))
    return F.when(~text.isin("{}", "[]"), text)


def flattened(df: DataFrame, struct: str, prefix: str) -> DataFrame:
    """A struct's fields as columns."""
    fields = df.schema[struct].dataType.names
    return df.select(*(c for c in df.columns if c != struct), *(F.col(f"{struct}.{f}").alias(f"{prefix}_{f}") for f in fields))


def identity(*sources: Column) -> Column:
    """The first source that is neither null nor empty."""
    return F.coalesce(*(F.nullif(s, F.lit("")) for s in sources))


def loose_flag(text: Column) -> Column:
    """A flag as people write it: true, yes, y, 1 and their opposites; anything else is unknown."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "y", "1", "1.0"), True).when(t.isin("false", "no", "n", "0", "0.0"), False)


def flag_or_null(df: DataFrame, column: str) -> Column:
    """A nullable flag of a table; where the column lacks, all are unknown."""
    return F.col(column).cast("boolean") if column in df.columns else F.lit(None).cast("boolean")


def typed(df: DataFrame) -> DataFrame:
    """Declared types after a text round trip; nullable stays nullable."""
    kind = lambda c: "bigint" if c in INT_COLUMNS else "boolean" if c in BOOL_COLUMNS else None
    return df.select(*(F.col(c).try_cast(kind(c)).alias(c) if kind(c) else F.col(c) for c in df.columns))


def write_tables(tables: dict[str, DataFrame], out: str, *, parquet: bool = True, csv: bool = False) -> None:
    """Parquet, with a CSV mirror if wanted; the committer makes each write whole or nothing."""
    for name, df in tables.items():
        if parquet:
            df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        if csv:
            flat = df.select(*(F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType | T.MapType | T.StructType) else F.col(c) for c in df.columns))
            flat.write.mode("overwrite").csv(f"{out}/{name}.csv", header=True)


def load_table(spark: SparkSession, at: str, name: str, schema: T.StructType) -> DataFrame:
    """The Parquet table, else its CSV mirror, else no rows of the schema."""
    for kind, read in (("parquet", lambda p: spark.read.schema(schema).parquet(p)), ("csv", lambda p: spark.read.csv(p, header=True, schema=schema))):
        try:
            df = read(f"{at}/{name}.{kind}")
            df.limit(0).count()
            return df
        except Exception as problem:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(problem):
                raise
    return spark.createDataFrame([], schema)


def manifest(tables: dict[str, DataFrame], version: str = "accounting_version") -> DataFrame:
    """(name, rows, versions, mixed): what a roll-up holds, and whether it mixes generations."""
    out = None
    for name, df in tables.items():
        v = F.col(version) if version in df.columns else F.lit(None).cast("string")
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(F.coalesce(v, F.lit("unset")))), ",").alias("versions"), (F.count_distinct(F.coalesce(v, F.lit("unset"))) > 1).alias("mixed"))
        out = one if out is None else out.unionByName(one)
    return out


def guarded(df: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """``df``, if one known version is all it has; else its use is an error."""
    seen = df.agg(F.collect_set(F.coalesce(F.col(column), F.lit("unset"))).alias("_seen"))
    bad = F.exists("_seen", lambda v: ~v.isin(*known)) | (F.size("_seen") > 1)
    checked = df.crossJoin(F.broadcast(seen))  # one row
    return checked.where(F.when(bad, F.raise_error(F.concat(F.lit("versions: "), F.array_join("_seen", ","))).cast("boolean")).otherwise(True)).drop("_seen")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two derivations agree, repeated rows included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def input_manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def workspace_files(spark: SparkSession, root: str, *, most: int = 2_000_000) -> DataFrame:
    """(path, text) of the text files below a folder: not too large, no NUL in the first 8 KiB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most)
    head = F.substring("content", 1, 8192)
    return files.where(~F.hex(head).rlike("^(?:..)*00")).select("path", F.decode("content", "UTF-8").alias("text"))


# schemas compiled to rules


def resolved(schema, root: dict):
    """A schema with its references to the same document put in their place; one inside itself is refused."""

    def walk(node, seen: tuple[str, ...]):
        if isinstance(node, list):
            return [walk(x, seen) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" in node:
            ref = node["$ref"]
            if not ref.startswith("#") or ref in seen:
                raise ValueError(f"reference not supported: {ref}")
            target = root
            for part in [p.replace("~1", "/").replace("~0", "~") for p in ref[1:].split("/")[1:]]:
                target = target[part]
            return walk({**target, **{k: v for k, v in node.items() if k != "$ref"}}, (*seen, ref))
        return {k: walk(v, seen) for k, v in node.items() if k not in ("$defs", "definitions")}

    return walk(schema, ())


def rules_of(schema: dict, path: str = "", at: Column | None = None) -> list[tuple[str, Column]]:
    """(message, condition that must not be false) for the keywords in use; an unknown keyword is refused.

    Keywords: type, enum, const, required, properties, pattern, minimum, maximum, their lengths,
    items, allOf, anyOf, oneOf, not, if/then/else, and $ref inside the document.
    """
    schema = resolved(schema, schema)
    known = {"oneOf", "not", "minLength", "maxLength", "minItems", "maxItems", "type", "enum", "const", "required", "properties", "additionalProperties", "pattern", "minimum", "maximum", "items", "allOf", "anyOf", "if", "then", "else", "description", "title", "$schema", "$id"}
    if extra := set(schema) - known:
        raise ValueError(f"keywords not supported: {', '.join(sorted(extra))}")
    get = (lambda name: F.col(name)) if at is None else (lambda name: at[name])
    out: list[tuple[str, Column]] = []
    label = path or "row"
    if at is not None:
        kinds = schema.get("type")
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if kinds and "null" not in kinds:
            out.append((f"{label}: null", at.isNotNull()))
        if "enum" in schema:
            out.append((f"{label}: not one of the values", at.isNull() | at.isin(*(v for v in schema["enum"] if v is not None))))
        if "const" in schema:
            out.append((f"{label}: not the value", at.eqNullSafe(F.lit(schema["const"]))))
        if "pattern" in schema:
            out.append((f"{label}: not of the form", at.isNull() | at.rlike(schema["pattern"])))
        sizes = (("minLength", lambda v: F.length(at) >= v), ("maxLength", lambda v: F.length(at) <= v), ("minItems", lambda v: F.size(at) >= v), ("maxItems", lambda v: F.size(at) <= v))
        for word, test in (("minimum", lambda v: at >= v), ("maximum", lambda v: at <= v), *sizes):
            if word in schema:
                out.append((f"{label}: {word}", at.isNull() | test(schema[word])))
        if "items" in schema:
            inner = schema["items"]
            out.append((f"{label}: an item", at.isNull() | F.forall(at, lambda x: holds(inner, x))))
    for name, sub in schema.get("properties", {}).items():
        need = name in schema.get("required", ()) and "type" in sub and "null" not in ([sub["type"]] if isinstance(sub["type"], str) else sub["type"])
        field = f"{path}.{name}" if path else name
        for message, ok in rules_of(sub, field, get(name)):
            out.append((message, ok if need or not message.endswith(": null") else F.lit(True)))
    for sub in schema.get("allOf", ()):
        out += rules_of(sub, path, at)
    if "anyOf" in schema:
        some = F.lit(False)
        for sub in schema["anyOf"]:
            some = some | _all(rules_of(sub, path, at))
        out.append((f"{label}: none of the alternatives", some))
    if "oneOf" in schema:
        held = sum((_all(rules_of(sub, path, at)).cast("int") for sub in schema["oneOf"]), F.lit(0))
        out.append((f"{label}: not one of the alternatives", held == 1))
    if "not" in schema:
        out.append((f"{label}: what it may not be", ~_all(rules_of(schema["not"], path, at))))
    if "if" in schema:
        given = _all(rules_of(schema["if"], path, at))
        for message, ok in rules_of(schema.get("then", {}), path, at):
            out.append((message, ~given | ok))
        for message, ok in rules_of(schema.get("else", {}), path, at):
            out.append((message, given | ok))
    return out


def _all(rules: list[tuple[str, Column]]) -> Column:
    out = F.lit(True)
    for _, ok in rules:
        out = out & F.coalesce(ok, F.lit(False))
    return out


def holds(schema: dict, at: Column) -> Column:
    return _all(rules_of(schema, "item", at))


def violations(df: DataFrame, schema: dict, *, most: int = 25) -> DataFrame:
    """(message, row as JSON) of rows that break a rule; as many rows as are asked for."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules_of(schema))), lambda m: m.isNotNull())
    rows = df.select(broken.alias("broken"), F.to_json(F.struct(*df.columns)).alias("row")).where(F.size("broken") > 0)
    return rows.select(F.array_join("broken", "; ").alias("message"), "row").limit(most)


def enum_drift(declared: DataFrame, used: DataFrame, column: str) -> DataFrame:
    """Values that only one side has."""
    a, b = declared.select(column).distinct(), used.select(column).distinct()
    return a.exceptAll(b).select(column, F.lit("declared only").alias("side")).unionByName(b.exceptAll(a).select(column, F.lit("used only").alias("side")))
