"""Problem 2: schemas that drift between files.

Method: lines are loaded as maps from path to value that keep the raw JSON type; statistics of each path and type are
aggregated by export; consecutive exports are compared, which gives the change report; and columns of one fixed type
are projected from the maps, with a report of the values that can't be cast.

Everything of the size of the data is a per-row expression or an aggregation that is partial before its shuffle. Only
what is as large as the number of exports and fields is ordered in windows, by station or field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.storage import Workspace

#: Keys that name a record; all others are fields. ``start`` only counts for ``segments``.
RECORD_KEYS = ("file_id", "start", "end", "speaker_id")
_END = "#end of line"
#: So many field names that are gone, new or get another column are broadcast with their exports; more join by a shuffle.
MOST_MOVES = 100_000
#: So many fields, those in most records, get a column each in the consistent table.
MOST_COLUMNS = 2_000
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def json_object(payload: Column) -> Column:
    """The map from key to variant of a payload that is exactly one JSON object, else null.

    Spark's parser ignores what follows a complete value. So the payload is parsed as the first of two elements of an
    array: text after the object then breaks the array, or moves or hides the mark that must be its second element.
    """
    both = F.from_json(F.concat(F.lit("["), payload, F.lit(f',{{"{_END}":1}}]')), "array<map<string,variant>>", _STRICT)
    whole = (F.size(both) == 2) & F.map_contains_key(F.get(both, F.lit(1)), F.lit(_END))
    return F.when(whole, F.get(both, F.lit(0)))


def _values(m: Column) -> Column:
    """Entries of a record as (path, kind, value): kind null for null, "" and "NaN"; equal values have equal ``value``.

    Of a key that an object has twice, the last value counts, as in most JSON readers.
    """
    entries = F.map_entries(m)
    entries = F.when(
        F.size(F.array_distinct(F.map_keys(m))) < F.size(m),
        F.filter(entries, lambda e, i: F.size(m) - F.array_position(F.reverse(F.map_keys(m)), e["key"]) == i),
    ).otherwise(entries)

    def number(t: Column, s: Column) -> Column:
        """One spelling for equal numbers, with all digits: plain ones without zeros at the end, others as doubles."""
        trimmed = lambda x: F.regexp_replace(x, r"\.0*$|(\.\d*?[1-9])0+$", "$1")
        # only numbers with an exponent are doubles here; those that fit a decimal are written like the others
        double = s.cast("double")
        wide = double.try_cast("decimal(38,18)")
        rare = F.when(wide.cast("double") == double, trimmed(wide.cast("string"))).otherwise(double.cast("string"))
        return F.when(t == "DOUBLE", rare).when(s.contains("."), trimmed(s)).otherwise(s)

    raw = F.transform(entries, lambda e: F.struct(e["key"].alias("path"), F.schema_of_variant(e["value"]).alias("t"), e["value"].cast("string").alias("s")))

    def typed(e: Column) -> Column:
        t, s = e["t"], e["s"]
        kind = (
            F.when((t == "VOID") | ((t == "STRING") & s.isin("", "NaN")), F.lit(None))
            .when(t == "STRING", F.lit("string"))
            .when(t == "BOOLEAN", F.lit("boolean"))
            .when(t.startswith("OBJECT"), F.lit("object"))
            .when(t.startswith("ARRAY"), F.lit("array"))
            .otherwise(F.lit("number"))
        )
        value = F.when(kind == "number", number(t, s)).otherwise(s)
        return F.struct(e["path"].alias("path"), kind.alias("kind"), F.when(kind.isNotNull(), value).alias("value"))

    return F.transform(raw, typed)


def load_records(exports: DataFrame) -> DataFrame:
    """Records of the export lines: ``export_id``, ``artefact``, ``station``, ``written_at``, ``cells``.

    ``cells`` holds (path, kind, value) of each key, with the raw kind of the value: number, string, boolean, object
    or array; null for the missing values null, "" and "NaN". Lines that aren't one JSON object have null ``cells``
    and stay, as they show that the export exists. A line that was delivered more than once counts once. Lines without
    ``export_id`` belong to no export and don't take part. Other columns are not read.
    """
    lines = exports.filter("export_id IS NOT NULL").select("export_id", "artefact", "station", "written_at", "payload").distinct()
    # parsed in a projection of its own, as the entries refer to the map more than once
    parsed = lines.withColumn("__map", json_object(F.col("payload")))
    return parsed.select("export_id", "artefact", "station", "written_at", _values(F.col("__map")).alias("cells"))


def export_order(records: DataFrame) -> DataFrame:
    """Exports with ``seq`` within station and artefact, by ``written_at`` (then id), the one before, and whether it is the last."""
    exports = records.groupBy("export_id", "artefact", "station").agg(F.min("written_at").alias("written_at"))
    w = Window.partitionBy("station", "artefact").orderBy("written_at", "export_id")
    return exports.select(
        "export_id", "station", "artefact", F.row_number().over(w).alias("seq"), F.lag("export_id").over(w).alias("before_id"), F.lead("export_id").over(w).alias("after_id")
    )


#: Of the values that are numbers: how many are whole, come back from a double, and come back from a decimal.
_SHAPES = {
    "numbers": "try_cast(c.value AS double) IS NOT NULL",
    "whole": "c.value RLIKE '^-?[0-9]{1,18}$' OR try_cast(c.value AS bigint) IS NOT NULL AND c.value NOT RLIKE '[.eE]'",
    "exact": "try_cast(c.value AS double) IS NOT NULL AND (c.value RLIKE '[eE]' OR length(c.value) <= 15 OR try_cast(c.value AS decimal(38,18)) = try_cast(try_cast(c.value AS double) AS decimal(38,18)))",
    "decimal": "try_cast(c.value AS double) IS NOT NULL AND c.value NOT RLIKE '[eE]|[.][0-9]{19}' AND try_cast(c.value AS decimal(38,18)) IS NOT NULL",
}


def field_statistics(records: DataFrame, shapes: bool = False) -> DataFrame:
    """By ``export_id`` and field: in how many records it ``occurs``, how many ``values`` it has, and their ``kind``.

    The kind is the one of most values, of equal ones the first by name; null if all are missing. With ``shapes``, also
    how many values are ``numbers``, and of these ``whole``, ``exact`` as a double, and ``decimal`` with up to 18 places.
    """
    cells = records.select("export_id", F.explode("cells").alias("c")).filter(~F.col("c.path").isin(*RECORD_KEYS))
    counted = [F.count_if(F.expr(test)).alias(name) for name, test in _SHAPES.items()] if shapes else []
    by_kind = cells.groupBy("export_id", F.col("c.path").alias("field_name"), F.col("c.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), *counted)
    return by_kind.groupBy("export_id", "field_name").agg(
        F.sum("n").alias("occurs"),
        F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0).cast("bigint")).alias("values"),
        F.min(F.when(F.col("kind").isNotNull(), F.struct((-F.col("n")).alias("n"), "kind"))).getField("kind").alias("kind"),
        *[F.sum(name).alias(name) for name in _SHAPES if shapes],
    )


def _renames(records: DataFrame, order: DataFrame, new: DataFrame, gone: DataFrame, space: Workspace) -> DataFrame:
    """(export_id, old, new) of the gone and new fields that agree in all records that both exports hold.

    Only exports with both are looked at. Up to ``MOST_MOVES`` of their names are sent to the records, so that of all others nothing
    is shuffled; more join by a shuffle.
    """
    olds = gone.groupBy("export_id").agg(F.collect_set("field_name").alias("olds"))
    news = new.groupBy("export_id").agg(F.collect_set("field_name").alias("news"))
    moves = space.write(order.select("export_id", "before_id").join(olds, "export_id").join(news, "export_id"), "moves")
    names = moves.agg(F.sum(F.size("olds") + F.size("news")).alias("n")).first()[0] or 0
    sent = F.broadcast if names <= MOST_MOVES else lambda df: df

    tagged = lambda c: F.concat_ws(":", c["kind"], c["value"])
    present = lambda c: F.when(c["kind"].isNotNull(), tagged(c))
    cell = lambda name: F.get(F.transform(F.filter("cells", lambda c: c["path"] == name), present), F.lit(0))
    key = [cell("file_id").alias("k_file"), cell("speaker_id").alias("k_speaker"), F.when(F.col("artefact") == "segments", cell("start")).otherwise(F.lit("")).alias("k_start")]
    pick = lambda fields: F.map_from_entries(F.transform(F.filter("cells", lambda c: F.array_contains(F.col(fields), c["path"])), lambda c: F.struct(c["path"], present(c))))
    now = records.join(sent(moves.select("export_id", "olds", "news")), "export_id").filter("cells IS NOT NULL")
    now = now.select("export_id", *key, "olds", "news", pick("news").alias("new_values"))
    past = records.withColumnRenamed("export_id", "before_id").join(sent(moves.select("export_id", "before_id", "olds")), "before_id").filter("cells IS NOT NULL")
    past = past.select("export_id", *key, pick("olds").alias("old_values"))
    both = now.join(past, ["export_id", "k_file", "k_speaker", "k_start"])
    # Two fields agree in all these pairs of records if the sums over the pairs of hashes of the pair and the value are
    # equal; so a pair gives one row a field, and not one for each gone and new field. 128 bits of hash are summed.
    side = lambda fields, values, new: F.transform(fields, lambda f: F.struct(F.lit(new).alias("new"), f.alias("field"), F.try_element_at(values, f).alias("value")))
    entries = lambda m: F.array_sort(F.map_entries(m))
    pair = F.xxhash64("k_file", "k_speaker", "k_start", entries("old_values"), entries("new_values"))
    cells = both.select("export_id", pair.alias("pair"), F.inline(F.concat(side("olds", F.col("old_values"), False), side("news", F.col("new_values"), True))))
    cells = cells.withColumn("h1", F.xxhash64("pair", "value")).withColumn("h2", F.xxhash64("value", F.col("value").isNull(), "pair"))
    parts = [F.sum(half(h)).alias(f"d{i}{h}") for h in ("h1", "h2") for i, half in enumerate((lambda h: F.shiftrightunsigned(h, 32), lambda h: F.col(h).bitwiseAND(0xFFFFFFFF)))]
    digests = cells.groupBy("export_id", "new", "field").agg(*parts, F.count("value").alias("n")).filter("n > 0")
    same = ["export_id", "n", *[f"d{i}{h}" for h in ("h1", "h2") for i in (0, 1)]]
    agree = digests.filter("NOT new").withColumnRenamed("field", "old").join(digests.filter("new").withColumnRenamed("field", "new_field"), same)
    agree = agree.select("export_id", "old", F.col("new_field").alias("new"), "n")
    # a field is renamed once: the pair with most values, then the first by name, from both sides
    for one, other in (("old", "new"), ("new", "old")):
        w = Window.partitionBy("export_id", one).orderBy(F.col("n").desc(), other)
        agree = agree.withColumn(f"rank_{one}", F.row_number().over(w))
    return agree.filter("rank_old = 1 AND rank_new = 1").select("export_id", "old", "new")


def _fields(records: DataFrame, space: Workspace, shapes: bool = False) -> tuple[DataFrame, DataFrame]:
    """The fields of each export, in order, and the renamings (``export_id``, ``old``, ``new``); ``records`` are a written table.

    A field has ``fresh`` = 1 where the export before doesn't have it, ``since`` (the export from which on it is there
    without a break), ``after_id`` and ``next_seq`` (the next export, and the next one with the field), and ``kept``, the
    last kind since then.
    """
    order = space.write(export_order(records), "order")
    stats = field_statistics(records, shapes).join(order, "export_id")
    w = Window.partitionBy("station", "artefact", "field_name").orderBy("seq")
    prev = F.lag("seq").over(w)
    stats = stats.withColumn("fresh", F.when(prev == F.col("seq") - 1, 0).otherwise(1))
    stats = stats.withColumn("since", F.last(F.when(F.col("fresh") == 1, F.col("export_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = Window.partitionBy("station", "artefact", "field_name", "since").orderBy("seq")
    stats = stats.withColumn("kept", F.last("kind", ignorenulls=True).over(c.rowsBetween(Window.unboundedPreceding, -1)))
    stats = stats.withColumn("next_seq", F.lead("seq").over(w))
    more = ["artefact", "occurs", "values", *_SHAPES] if shapes else []
    stats = space.write(stats.select("export_id", "after_id", "field_name", "seq", "next_seq", "fresh", "since", "kind", "kept", *more), "fields")
    return stats, space.write(_renames(records, order, _new(stats), _gone(stats), space), "renames")


def _new(fields: DataFrame) -> DataFrame:
    return fields.filter("fresh = 1 AND seq > 1").select("export_id", "field_name")


def _gone(fields: DataFrame) -> DataFrame:
    return fields.filter("after_id IS NOT NULL AND (next_seq IS NULL OR next_seq > seq + 1)").select(F.col("after_id").alias("export_id"), "field_name")


def drift_report(records: DataFrame, stored: bool = False) -> DataFrame:
    """``export_id``, ``field_name``, ``change``, ``former_name``: each change of an export against the one before it.

    ``records`` as of ``load_records`` (``stored``: they are a written table already). ``change`` is ``added``, ``removed`` (``field_name`` is the former one),
    ``retyped`` or ``renamed``. A field without values in an export keeps its kind while it stays in the exports. The
    first export of a station and artefact has no changes; one without any record has no fields. An empty table gives
    an empty report. Records without a full key are no evidence for a renaming.
    """
    space = Workspace(records.sparkSession)
    fields, renamed = _fields(records if stored else space.write(records, "records"), space)
    none = F.lit(None).cast("string").alias("former_name")
    parts = [
        _new(fields).join(renamed.withColumnRenamed("new", "field_name"), ["export_id", "field_name"], "left_anti").select("*", F.lit("added").alias("change"), none),
        _gone(fields).join(renamed.withColumnRenamed("old", "field_name"), ["export_id", "field_name"], "left_anti").select("*", F.lit("removed").alias("change"), none),
        fields.filter("fresh = 0 AND kind <> kept").select("export_id", "field_name", F.lit("retyped").alias("change"), none),
        renamed.select("export_id", F.col("new").alias("field_name"), F.lit("renamed").alias("change"), F.col("old").alias("former_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_names(fields: DataFrame, renamed: DataFrame, space: Workspace) -> DataFrame:
    """``export_id``, ``field_name``, ``column``: where the values of a field go, for the fields that get another name.

    Renamings join the fields of one station and artefact to lines, export by export. All of a line is loaded under that
    of its names which is in most records of the artefact (of equal ones the first), without the names that fields of
    other lines have in the same exports; where none is left, fields keep their own names. A field also keeps it where
    another one that is first by name goes to that column: so no two fields of a record have one column, and no value is lost.
    """
    here = fields.select("artefact", "export_id", "field_name", "since", "occurs", F.struct("since", "field_name").alias("line"))
    past = fields.select(F.col("after_id").alias("export_id"), F.col("field_name").alias("old"), F.struct("since", "field_name").alias("root"))
    roots = space.write(renamed.join(past, ["export_id", "old"]).select(F.struct(F.col("export_id").alias("since"), F.col("new").alias("field_name")).alias("line"), "root"), "roots0")
    step, moved = 0, roots.count()
    while moved:  # each round doubles the length of the lines that are joined
        step += 1
        onward = roots.select(F.col("line").alias("root"), F.col("root").alias("__on"))
        both = roots.join(onward, "root", "left")
        roots = space.write(both.select("line", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("moved")), f"roots{step}")
        moved = roots.filter("moved").count()
        roots = roots.drop("moved")
    here = here.join(roots, "line", "left").withColumn("root", F.coalesce("root", "line"))
    popular = fields.groupBy("artefact", "field_name").agg(F.sum("occurs").alias("n"))
    # only lines of more than one name; a name that another line has in an export of this one is no choice
    many = here.join(roots.select("root").distinct(), "root", "left_semi")
    names = many.select("artefact", "root", F.col("field_name").alias("column")).distinct()
    others = here.select("export_id", F.col("field_name").alias("column"), F.col("root").alias("__other"))
    taken = many.select("root", "export_id").join(names, "root").join(others, ["export_id", "column"]).filter("__other <> root").select("root", "column").distinct()
    free = names.join(taken, ["root", "column"], "left_anti").join(popular.withColumnRenamed("field_name", "column"), ["artefact", "column"])
    named = free.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), "column"))["column"].alias("column"))
    wanted = many.join(named, "root").select("export_id", "field_name", "column")
    own = fields.select("export_id", F.col("field_name").alias("column"))
    free = wanted.filter("column <> field_name").join(own, ["export_id", "column"], "left_anti")
    first = free.groupBy("export_id", "column").agg(F.min("field_name").alias("field_name"))
    return space.write(first.select("export_id", "field_name", "column"), "columns")


def _placed(records: DataFrame, columns: DataFrame) -> DataFrame:
    """``records`` whose cells also have ``field``, the name in the file, where ``path`` is now the column."""
    moves = columns.groupBy("export_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "column"))).alias("moves"))
    sent = F.broadcast(moves) if columns.count() <= MOST_MOVES else moves
    rows = records.filter("cells IS NOT NULL").join(sent, "export_id", "left")
    place = lambda c: F.coalesce(F.try_element_at("moves", c["path"]), c["path"])
    return rows.withColumn("cells", F.transform("cells", lambda c: F.struct(place(c).alias("path"), c["path"].alias("field"), c["kind"].alias("kind"), c["value"].alias("value")))).drop("moves")


def column_types(fields: DataFrame, columns: DataFrame) -> dict[str, str]:
    """The type of each column, of the ``MOST_COLUMNS`` that are in most records; others have none.

    It is that of most values: boolean; string (also of objects and arrays, as JSON); or a number: bigint if all values
    that are numbers are whole, double if each comes back from one, else decimal(38,18) or, if that can't hold them, string.
    """
    at = fields.join(columns, ["export_id", "field_name"], "left").withColumn("column", F.coalesce("column", "field_name"))
    votes = at.filter("kind IS NOT NULL").groupBy("column", "kind").agg(F.sum("values").alias("n"))
    kinds = votes.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).getField("kind").alias("kind"))
    shapes = at.groupBy("column").agg(F.sum("occurs").alias("occurs"), *[F.sum(x).alias(x) for x in _SHAPES])
    number = F.expr("CASE WHEN whole = numbers THEN 'bigint' WHEN exact = numbers THEN 'double' WHEN `decimal` = numbers THEN 'decimal(38,18)' ELSE 'string' END")
    chosen = kinds.join(shapes, "column").select("column", "occurs", F.when(F.col("kind") == "number", number).when(F.col("kind") == "boolean", "boolean").otherwise("string").alias("type"))
    found = chosen.orderBy(F.col("occurs").desc(), "column").limit(MOST_COLUMNS).collect()
    return {r["column"]: r["type"] for r in sorted(found, key=lambda r: r["column"])}


def consistent_table(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All records as one table of typed columns, and a report of what couldn't be cast; ``records`` are a written table.

    Columns are named as of ``column_names`` and typed as of ``column_types``. A value that can't be cast is null in the table and
    counted in the report: ``export_id``, ``field_name`` (in the file), ``column_name``, ``type``, ``values``, ``failed``. The table starts
    with the export and the record keys; a field that is called like one of these gets the prefix ``field_``. Fields without a
    column of their own, which there only are where more than ``MOST_COLUMNS`` occur, are kept as text in the map ``other_fields``.
    """
    placed, types = _consistent(records)
    # of a name that a table can't have twice (names don't differ by case) the later ones get their number
    taken: dict[str, str] = {}
    used = {"export_id", "artefact", "station", "written_at", *RECORD_KEYS, "other_fields"}
    for c in types:
        name = f"field_{c}" if c.lower() in used else c
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        taken[c] = name
    rows = placed.withColumn("__m", F.map_from_entries(F.transform("cells", lambda c: F.struct(c["path"], c["value"]))))
    key = [F.try_element_at("__m", F.lit(k)).try_cast("double" if k in ("start", "end") else "string").alias(k) for k in RECORD_KEYS]
    cells = [F.try_element_at("__m", F.lit(c)).try_cast(t).alias(taken[c]) for c, t in types.items()]
    rest = []
    if len(types) == MOST_COLUMNS:
        mine = F.array(*[F.lit(c) for c in [*types, *RECORD_KEYS]])
        rest = [F.map_filter("__m", lambda k, v: ~F.array_contains(mine, k)).alias("other_fields")]
    table = rows.select("export_id", "artefact", "station", "written_at", *key, *cells, *rest)
    return table, _casts(placed, types)


def _consistent(records: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    space = Workspace(records.sparkSession)
    fields, renamed = _fields(records, space, shapes=True)
    columns = column_names(fields, renamed, space)
    return _placed(records, columns), column_types(fields, columns)


def _casts(placed: DataFrame, types: dict[str, str]) -> DataFrame:
    to_type = F.create_map(*[F.lit(x) for pair in types.items() for x in pair]) if types else F.lit(None).cast("map<string,string>")
    cells = placed.select("export_id", F.explode("cells").alias("c")).filter("c.kind IS NOT NULL").filter(~F.col("c.field").isin(*RECORD_KEYS))
    cells = cells.select("export_id", F.col("c.field").alias("field_name"), F.col("c.path").alias("column_name"), F.coalesce(F.try_element_at(to_type, F.col("c.path")), F.lit("string")).alias("type"), F.col("c.value").alias("value"))
    tests = " ".join(f"WHEN '{t}' THEN try_cast(value AS {t}) IS NULL" for t in ("bigint", "double", "boolean", "decimal(38,18)"))
    return cells.groupBy("export_id", "field_name", "column_name", "type").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.expr(f"CASE type {tests} ELSE false END")).alias("failed"))


def consistent_values(records: DataFrame) -> DataFrame:
    """The consistent table as rows: ``export_id``, ``file_id``, ``speaker_id``, ``start`` (as text), ``column_name`` and ``value`` (as text), one for each value that could be cast."""
    placed, types = _consistent(records)
    to_type = F.create_map(*[F.lit(x) for pair in types.items() for x in pair]) if types else F.lit(None).cast("map<string,string>")
    at = lambda name: F.try_element_at(F.filter("cells", lambda c: (c["field"] == name) & c["kind"].isNotNull()), F.lit(1))["value"].alias(name)
    rows = placed.select("export_id", at("file_id"), at("speaker_id"), at("start"), F.explode("cells").alias("c")).filter("c.kind IS NOT NULL").filter(~F.col("c.field").isin(*RECORD_KEYS))
    rows = rows.select("export_id", "file_id", "speaker_id", "start", F.col("c.path").alias("column_name"), F.coalesce(F.try_element_at(to_type, F.col("c.path")), F.lit("string")).alias("type"), F.col("c.value").alias("value"))
    tests = " ".join(f"WHEN '{t}' THEN try_cast(value AS {t}) IS NULL" for t in ("bigint", "double", "boolean", "decimal(38,18)"))
    return rows.filter(F.expr(f"NOT CASE type {tests} ELSE false END")).drop("type")
