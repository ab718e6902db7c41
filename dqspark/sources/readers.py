"""Raw files as DataFrames: delimited text, header-checked CSV, fixed-width lines, XML actions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dqspark.session import materialize


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything on its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


CORRUPT = "_corrupt"


#: Characters of a record of several lines up to which these are put together.
RECORD_MOST = 1 << 24


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of every line with its file, the start of its split, and its order in the split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"),
                                         F.col("_metadata.file_block_start").alias("_block"))
    return lines.withColumn("_id", F.monotonically_increasing_id())


def _left_open(sep: str) -> tuple[Column, Column]:
    """Whether a quote stands open after a line that begins outside of quotes, and after one inside.

    A quote opens at the start of a field only; a doubled one inside is a character.
    """
    s = f"\\x{{{ord(sep):x}}}"
    inner = r'[^"]*+(?:""[^"]*+)*+'
    fields = f'(?:(?:"{inner}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+'
    line = F.col("value")
    quoted = F.contains(line, F.lit('"'))
    return (quoted & line.rlike(f'^{fields}"{inner}\\z'),
            ~quoted | line.rlike(f'^{inner}\\z') | line.rlike(f'^{inner}"[^{s}]*+{s}{fields}"{inner}\\z'))


def _compose(df: DataFrame, part: Sequence[str], order: str) -> DataFrame:
    """Add ``_known`` and ``_odd``: what the steps up to each row, in order, make of a starting state.

    A step sets the state (``_set`` is not NULL), or turns it (``_flip``), or leaves it. After all of them it is
    ``_known``, or where nothing set it, the starting state, turned if ``_odd``.
    """
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_turns", F.sum(F.when(F.col("_set").isNull() & F.col("_flip"), 1).otherwise(0)).over(upto))
    df = df.withColumn("_last", F.last(F.when(
        F.col("_set").isNotNull(), F.struct("_set", "_turns")), True).over(upto))
    df = df.withColumn("_odd", (F.col("_turns") - F.coalesce("_last._turns", F.lit(0))) % 2 == 1)
    return df.withColumn("_known", F.col("_last._set") != F.col("_odd")).drop("_turns", "_last", "_set", "_flip")


def _joined_lines(lines: DataFrame, sep: str) -> DataFrame:
    """Records ``(value, _path, _block, _id)`` of placed lines, quoted line breaks inside, at their first line.

    Every line sets, turns or leaves the state "inside quotes". Composing the lines of a split, and the splits of
    a file (one short row each), gives every line its state, so no file passes through one task. Only lines of
    records of several lines are grouped. A record that is never closed, or is longer than
    ``RECORD_MOST``, is given back line by line.
    """
    split, outside, inside = ["_path", "_block"], *_left_open(sep)
    state = lines.select("*", outside.alias("_from_out"), inside.alias("_from_in"))
    same = F.col("_from_out") == F.col("_from_in")
    state = state.withColumn("_set", F.when(same, F.col("_from_out"))).withColumn("_flip", F.col("_from_out") & ~same)
    state = _compose(state, split, "_id")
    ends = state.groupBy(*split).agg(F.max_by(F.struct("_known", "_odd"), "_id").alias("_e"))
    ends = _compose(ends.select(*split, F.col("_e._known").alias("_set"), F.col("_e._odd").alias("_flip")), ["_path"], "_block")
    after = F.coalesce("_known", "_odd")                              # a file begins outside of quotes
    ends = ends.select(*split, F.lag(after, 1, False).over(Window.partitionBy("_path").orderBy("_block")).alias("_start"))
    order = Window.partitionBy(*split).orderBy("_id")
    state = state.withColumn("_was", F.lag(F.struct("_known", "_odd")).over(order)).join(ends, split)
    begins = F.coalesce("_was._known", F.col("_start") != F.coalesce("_was._odd", F.lit(False)))
    state = state.withColumn("_inside", begins).withColumn(
        "_open", F.when(F.col("_inside"), F.col("_from_in")).otherwise(F.col("_from_out")))
    # a line inside belongs to the last line before it that begins outside, be it in an earlier split
    head = F.when(~F.col("_inside"), F.struct(F.col("_block").alias("block"), F.col("_id").alias("id")))
    state = state.withColumn("_head", F.last(head, True).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    last = state.groupBy(*split).agg(F.max_by("_head", "_id").alias("_head"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*split, F.last("_head", True).over(earlier).alias("_before"))
    state = state.join(last, split).select(
        "value", *split, "_id", "_inside", "_open", F.coalesce("_head", "_before").alias("_head"))
    state = materialize(state, "quoted-lines")

    place = ["value", *split, "_id"]
    alone = state.filter("not _inside and not _open").select(*place)
    several = state.filter("_inside or _open")
    at = F.struct("_block", "_id")
    whole = several.groupBy("_path", "_head").agg(
        F.sum(F.length("value") + 1).alias("_chars"), F.max_by("_open", at).alias("_unclosed"))
    several = several.join(whole, ["_path", "_head"])
    fits = ~F.col("_unclosed") & (F.col("_chars") <= RECORD_MOST)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_id", "value"))), lambda x: x["value"])
    joined = several.filter(fits).groupBy("_path", "_head").agg(F.array_join(texts, "\n").alias("value")).select(
        "value", "_path", F.col("_head.block").alias("_block"), F.col("_head.id").alias("_id"))
    return alone.unionByName(joined).unionByName(several.filter(~fits).select(*place))


def _records(lines: DataFrame, sep: str) -> DataFrame:
    """Records of placed lines. Where no line leaves a quote open, lines are records, and nothing is shuffled."""
    broken = not lines.filter(_left_open(sep)[0]).isEmpty()
    return (_joined_lines(lines, sep) if broken else lines).filter("trim(value) <> ''")


def _csv(record: str, schema: StructType, sep: str, **options: str) -> Column:
    return F.from_csv(record, _ddl(schema), {"sep": sep, "escape": '"', **options})


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "|") -> DataFrame | None:
    """A headerless delimited file with declared names and types; None when it is absent.

    A quoted field may hold separators, doubled quotes and line breaks (read as ``\\n``); files stay
    splittable. ``_corrupt`` keeps the whole record where a field does not fit its type or the number of
    fields is wrong, and is NULL elsewhere, so no value is lost unseen. A quote that is never closed
    breaks its own line only. Records are parsed whole whatever columns are read later.
    """
    if not path_exists(spark, path):
        return None
    declared = StructType.fromDDL(schema)
    if CORRUPT not in declared.names:
        declared = declared.add(CORRUPT, StringType())
    row = _csv("value", declared, sep, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return _records(_placed_lines(spark, path), sep).select(row.alias("r")).select("r.*")


def read_contract(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header whose column names and order must equal the declared schema.

    The first line of every file is its header; a later line equal to it is data. Quoted line breaks are
    as in ``read_delimited``. A record that breaks the schema in any column stops the job that reads.
    """
    wanted = StructType.fromDDL(schema)
    lines = _placed_lines(spark, path)
    head = lines.select("value").first()                              # reads the first line only
    found = [] if head is None else spark.range(1).select(
        F.from_csv(F.lit(head["value"]), ", ".join(f"c{i} string" for i in range(len(wanted) + 1))).alias("r")
    ).first()["r"]
    found = [x for x in found if x is not None]
    if found != wanted.names:
        raise ValueError(f"columns of {path} are {found}, the contract says {wanted.names}")
    is_head = F.col("value") == head["value"]
    first = lines.groupBy("_path").agg(F.min(F.when(F.col("_block") == 0, F.col("_id"))).alias("_id"),
                                       F.min(F.when(is_head & (F.col("_block") == 0), F.col("_id"))).alias("_head"),
                                       F.count_if(is_head).alias("_n"))
    seen = first.agg(F.bool_and(F.col("_head").eqNullSafe(F.col("_id"))).alias("all"), F.max("_n").alias("n")).first()
    if not seen["all"]:
        raise ValueError(f"a file of {path} begins with another line than {head['value']!r}")
    if seen["n"] == 1:
        body = lines.filter(~is_head)
    else:
        body = lines.join(first.select("_path", "_id"), ["_path", "_id"], "left_anti")
    row = _csv("value", wanted, ",", mode="FAILFAST")
    return _records(body, ",").select(row.alias("r")).select("r.*")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def numbered(df: DataFrame, each: Column | None = None,
             prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``source_file`` and the 0-based position ``line_no`` of each record in its file.

    ``each`` is an array of the records in one line of ``df``, which take its place as ``value``.
    ``prepare`` may add columns that ``each`` uses to the lines, which have ``_path``, ``_block`` and, in
    order within these, ``_id``.

    Records of one split are read in order by one task, so a record's place in its split is its
    distance from the split's first id; split sizes (one short row per split) give the offset. No
    file passes through one task. Hidden file columns are consumed here.
    """
    raw = df.select("*", F.col("_metadata.file_path").alias("_path"),
                    F.col("_metadata.file_name").alias("source_file"),
                    F.col("_metadata.file_block_start").alias("_block"))
    if prepare is not None:
        raw = prepare(raw.withColumn("_id", F.monotonically_increasing_id()))
    if each is not None:
        raw = raw.select("_path", "source_file", "_block", F.explode(each).alias("value"),
                         *(["_id"] if prepare is not None else []))
    if prepare is not None:      # lines were dealt anew: their places follow from their old order
        raw = raw.withColumn("_at", F.row_number().over(Window.partitionBy("_path", "_block").orderBy("_id")))
        raw = raw.withColumn("_id", F.col("_at").cast("long")).drop("_at")
    else:
        raw = raw.withColumn("_id", F.monotonically_increasing_id())
    splits = raw.groupBy("_path", "_block").agg(F.min("_id").alias("_first"),
                                                F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    splits = splits.select("_path", "_block", "_first",
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return raw.join(splits, ["_path", "_block"]).withColumn(
        "line_no", F.col("_offset") + F.col("_id") - F.col("_first")).drop(
        "_block", "_id", "_first", "_offset")


def read_fixed_width_lines(spark: SparkSession, folder: str, glob: str,
                           skip_suffix: str = "_audit.csv") -> DataFrame:
    """Lines of fixed-width files: source_file, line_no, pts (1-15), rec_type (16-18), line."""
    lines = spark.read.option("pathGlobFilter", glob).text(folder)
    lines = numbered(lines).filter(~F.col("source_file").endswith(skip_suffix))
    return lines.select("source_file", "line_no", F.substring("value", 1, 15).alias("pts"),
                        F.substring("value", 16, 3).alias("rec_type"), F.col("value").alias("line"))


def slice_records(lines: DataFrame, rec_type: str, layout: Mapping[str, tuple[int, int, str]],
                  line: str = "line") -> DataFrame:
    """Trimmed and typed slices of one record type; a failed cast is NULL, blank text is ''.

    layout: name -> (1-based start, length, type).
    """
    def field(start: int, length: int, kind: str) -> Column:
        text = F.trim(F.substring(line, start, length))
        return text if kind == "string" else text.try_cast(kind)

    cols = [field(*spec).alias(name) for name, spec in layout.items()]
    return lines.filter(F.col("rec_type") == rec_type).select("pts", *cols)


def latest(df: DataFrame, key: Sequence[str], by: str) -> DataFrame:
    """The row with the largest ``by`` per key, later columns deciding ties.

    A maximum over (by, row) combines on the map side; no group is sorted in one task.
    """
    rest = [c for c in df.columns if c not in key and c != by]
    best = df.groupBy(*key).agg(F.max(F.struct(by, *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


def _action_schema() -> StructType:
    from pyspark.sql.types import ArrayType
    phone = StructType(_strings("C_CTRY_CODE", "C_AREA_CODE", "C_LOCAL", "C_EXT"))
    account = ArrayType(StructType(_strings("_CA_ID", "_CA_TAX_ST", "CA_B_ID", "CA_NAME")))
    customer = StructType([
        *_strings("_C_ID", "_C_TAX_ID", "_C_GNDR", "_C_TIER", "_C_DOB"),
        StructField("Name", StructType(_strings("C_L_NAME", "C_F_NAME", "C_M_NAME"))),
        StructField("Address", StructType(_strings(
            "C_ADLINE1", "C_ADLINE2", "C_ZIPCODE", "C_CITY", "C_STATE_PROV", "C_CTRY"))),
        StructField("ContactInfo", StructType([
            *_strings("C_PRIM_EMAIL", "C_ALT_EMAIL"),
            *[StructField(f"C_PHONE_{i}", phone) for i in (1, 2, 3)]])),
        StructField("TaxInfo", StructType(_strings("C_LCL_TX_ID", "C_NAT_TX_ID"))),
        StructField("Account", account)])
    return StructType([*_strings("_ActionType", "_ActionTS", "_C_ID"),
                       StructField("Customer", customer), StructField("Account", account)])


_OPEN, _CLOSE = "<!--", "-->"


def _last_mark() -> Column:
    """Whether the last comment mark of a chunk opens one; NULL without a mark."""
    plain = F.regexp_replace("value", r"(?s)<!\[CDATA\[.*?\]\]>", "")
    mark = F.regexp_extract(plain, f"(?s)^.*({_OPEN}|{_CLOSE})", 1)
    return F.when(mark != "", mark == _OPEN)


def _open_before(raw: DataFrame) -> DataFrame:
    """Add ``_open``: whether a comment stands open where a chunk begins.

    The last comment mark before a chunk tells. Every split gives its last mark, one short row; those of
    earlier splits reach a split by a window over these rows, and inside a split the chunks are
    looked through in order, so no file passes through one task.
    """
    raw = raw.withColumn("_mark", _last_mark())
    ends = raw.groupBy("_path", "_block").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_id"))).alias("_end"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_path", "_block", F.last("_end", True).over(earlier).alias("_start"))
    before = Window.partitionBy("_path", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    met = raw.withColumn("_last", F.last("_mark", True).over(before)).join(ends, ["_path", "_block"])
    return met.withColumn("_open", F.coalesce("_last", "_start", F.lit(False))).drop("_last", "_start", "_mark")


def _without_comments(opened: Column) -> Column:
    """The text of a chunk that stands in no comment; ``opened``: one stands open where it begins."""
    text = F.when(opened, F.when(F.instr("value", _CLOSE) == 0, F.lit("")).otherwise(
        F.regexp_replace("value", f"(?s)^.*?{_CLOSE}", ""))).otherwise(F.col("value"))
    return F.regexp_replace(text, f"(?s){_OPEN}.*?(?:{_CLOSE}|$)", "")


_START, _END = r"<TPCDI:Action(?=[\s/>])", "</TPCDI:Action>"


def read_actions_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(customer actions, account actions) of customer-management XML; None when absent.

    ``action_seq`` numbers the actions in document order, files in path order. A document is read
    as text cut at the ends of its actions, so one large document is many tasks; an action that is
    not well-formed raises. Actions in comments are none; an action must not hold a commented end of
    another, and CDATA sections must not hold ends of actions. One scan looks for comments that reach over
    the end of an action; without any, the actions of a split are not put in order.
    """
    if not path_exists(spark, path):
        return None
    chunks = spark.read.option("lineSep", _END).text(path)
    across = not chunks.filter(_last_mark()).isEmpty()
    text = _without_comments(F.col("_open") if across else F.lit(False))
    parts = F.filter(F.split(text, f"(?={_START})"), lambda x: x.rlike(f"^{_START}"))
    closed = F.transform(parts, lambda x: F.when(x.rlike(rf"^{_START}[^>]*/>\s*$"), x).otherwise(
        F.concat(x, F.lit(_END))))
    placed = numbered(chunks, closed, _open_before if across else None)
    per_file = placed.groupBy("_path").agg(F.count(F.lit(1)).alias("_n"))     # one row per file
    earlier = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select("_path", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    action = F.from_xml(F.col("value"), _action_schema(), {"mode": "FAILFAST"})
    placed = placed.join(offsets, "_path").select(
        (F.col("_o") + F.col("line_no") + 1).alias("action_seq"), action.alias("a"))
    return _actions(placed)


def no_actions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The two action tables without rows."""
    schema = StructType([StructField("action_seq", LongType()), StructField("a", _action_schema())])
    return _actions(spark.createDataFrame([], schema))


def _actions(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    placed = placed.select(
        "action_seq", F.col("a._ActionType").alias("action_type"), F.col("a._ActionTS").alias("action_ts"),
        F.col("a._C_ID").alias("_own"), "a.Customer", "a.Account")

    def text(c: str) -> Column:
        return F.trim(F.col(c))

    def phone(i: int) -> Column:
        p = f"Customer.ContactInfo.C_PHONE_{i}"
        parts = [F.coalesce(text(f"{p}.{c}"), F.lit(""))
                 for c in ("C_CTRY_CODE", "C_AREA_CODE", "C_LOCAL", "C_EXT")]
        return F.when(F.col(p).isNotNull(), F.concat_ws("|", *parts)).alias(f"c_phone_{i}")

    attributes = [F.col(f"Customer._{c}").alias(c.lower())
                  for c in ("C_ID", "C_TAX_ID", "C_GNDR", "C_TIER", "C_DOB")]
    nested = [text(f"Customer.{group}.{c}").alias(c.lower()) for group, cols in (
        ("Name", ("C_L_NAME", "C_F_NAME", "C_M_NAME")),
        ("Address", ("C_ADLINE1", "C_ADLINE2", "C_ZIPCODE", "C_CITY", "C_STATE_PROV", "C_CTRY")),
        ("ContactInfo", ("C_PRIM_EMAIL", "C_ALT_EMAIL"))) for c in cols]
    tax = [text(f"Customer.TaxInfo.{c}").alias(c.lower()) for c in ("C_LCL_TX_ID", "C_NAT_TX_ID")]
    head = ["action_seq", "action_type", "action_ts"]
    customers = placed.filter("Customer is not null").select(
        *head, *attributes, *nested, phone(1), phone(2), phone(3), *tax)
    with_customer = F.col("Customer").isNotNull()
    # An action without a customer carries at most one account of its own.
    accounts = placed.select(*head, F.when(with_customer, F.col("Customer._C_ID")).otherwise(
        F.col("_own")).alias("c_id"), F.explode(F.when(
            with_customer, F.col("Customer.Account")).otherwise(
            F.slice("Account", 1, 1))).alias("a"))
    accounts = accounts.select(*head, "c_id", F.col("a._CA_ID").alias("ca_id"),
                               F.col("a._CA_TAX_ST").alias("ca_tax_st"),
                               text("a.CA_B_ID").alias("ca_b_id"), text("a.CA_NAME").alias("ca_name"))
    return customers, accounts
