"""The sample tables read as evidence. Every binding uses all rows of its tables.

``calls``: one row of ``events`` is one call record. The hour is the case, hour and event type
are the evidence file, so that cases stay separate and some rules fire and others do not.
``transfers``: one row of ``lineitem`` is one ledger row. Customer nation and order month are the
case, the order is the evidence file, customer pays supplier.
``artifact_digests``: one row of ``orders`` is one evidence file of its customer's case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.runtime import few_tasks

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, scan: DataFrame) -> DataFrame:
    """``rows`` over all cores, in four parts each, when their scan has fewer splits than there are cores,
    which happens only for tables of a few files; a large table is never reshuffled here."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if scan.rdd.getNumPartitions() >= cores else rows.repartition(4 * cores)


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def raw_calls(spark: SparkSession, sf: str, hourly: bool = True,
              events: DataFrame | None = None) -> DataFrame:
    """Call records as text columns, before normalization."""
    k = F.get_json_object("props", "$.k").cast("long")
    case_id = (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).cast("long")
    if hourly:
        case_id = case_id * 100 + F.hour("ts")
    type_no = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type"))
    if events is None:
        events = spread(table(spark, sf, "events"), table(spark, sf, "events"))
    events = events.select("event_id", "ts", "user_id", "event_type", k.alias("k"))
    return events.select(
        case_id.alias("case_id"), (case_id * 10 + type_no).cast("long").alias("evidence_file_id"),
        F.col("event_id").alias("rec_no"), F.col("ts").cast("timestamp_ntz").alias("event_ts"),
        F.concat(F.lit("9"), F.lpad(_text("user_id"), 9, "0")).alias("caller"),
        F.concat(F.lit("9"), F.lpad(_text((F.col("user_id") * 7 + F.col("event_id")) % 400), 9, "0")
                 ).alias("callee"),
        F.concat(F.lit("86"), F.lpad(_text("k"), 13, "0")).alias("imei"),
        F.concat(F.lit("10.0."), _text(F.col("k") % 8), F.lit("."), _text(F.col("k") + 1)).alias("ip"))


def calls(spark: SparkSession, sf: str, hourly: bool = True,
          events: DataFrame | None = None) -> DataFrame:
    keep = ["case_id", "evidence_file_id", "rec_no", "event_ts"]
    return raw_calls(spark, sf, hourly, events).select(
        *keep, N.phone(F.col("caller")).alias("caller"), N.phone(F.col("callee")).alias("callee"),
        N.imei(F.col("imei")).alias("imei"), N.ip(F.col("ip")).alias("ip"))


def raw_transfers(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows as text columns, before normalization."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = spread(items.join(placed, F.col("l_orderkey") == F.col("o_orderkey")), items)
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    phone = F.concat(F.lit("9"), F.lpad(_text("o_custkey"), 9, "0"))
    return rows.select(
        (F.col("c_nationkey") * 1_000_000 + month).cast("long").alias("case_id"),
        F.col("l_orderkey").alias("evidence_file_id"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey")).alias("rec_no"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("event_ts"),
        F.concat(F.lit("CUST ACC "), _text("o_custkey")).alias("sender"),
        F.concat(F.lit("SUPP-ACC-"), _text("l_suppkey")).alias("receiver"),
        F.concat(phone, F.lit("@OkBank")).alias("upi"),
        F.concat(F.lit("INR "), F.format_number("l_extendedprice", 2)).alias("amount"))


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    keep = ["case_id", "evidence_file_id", "rec_no", "event_ts"]
    clean = raw_transfers(spark, sf).select(
        *keep, N.account(F.col("sender")).alias("sender"), N.account(F.col("receiver")).alias("receiver"),
        N.account(F.col("upi")).alias("upi"))
    return clean.withColumn("phone", N.phone_of_handle(F.col("upi")))


def text_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and pages as plain-text device dumps; the language or 'page' is the case."""
    lang = F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang"))
    docs = table(spark, sf, "documents").select(
        lang.cast("long").alias("case_id"), (F.col("doc_id") * 2).alias("evidence_file_id"), "text")
    pages = table(spark, sf, "pages").select(
        F.lit(9).cast("long").alias("case_id"), (F.col("page_id") * 2 + 1).alias("evidence_file_id"),
        F.col("html").alias("text"))
    return spread(docs.unionByName(pages), docs)


def artifact_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence files with a digest over integer and text columns."""
    payload = F.concat_ws("|", _text("o_orderkey"), _text("o_custkey"), "o_orderstatus",
                          "o_orderpriority")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("evidence_file_id"),
        F.col("o_orderkey").alias("entry_id"), F.sha2(payload, 256).alias("file_hash"))


def write_folder(lines: DataFrame, root: str, source_type: str) -> None:
    """``lines`` (case_id, part, line_no, value) as evidence of one type, one file per case and part.

    The order of the lines outlives the write because it begins with the columns of the folders; a
    constant type among them would be taken out of the sort, so the type is a part of the path. The number of
    tasks is given, as parts of few bytes would be put together into one task, however many files they are.
    """
    keys = ["case_id", "part"]
    lines.repartition(few_tasks(lines.sparkSession), *keys).sortWithinPartitions(*keys, "line_no").select(*keys, "value").write.partitionBy(
        *keys).text(f"{root}/source_type={source_type}")


def part_of(path: Column) -> Column:
    return F.regexp_extract(path, "part=([^/]+)", 1).cast("long")


def call_files(spark: SparkSession, sf: str, hourly: bool = True) -> DataFrame:
    """Call records as lines of CSV files, one file per hour (or day) and event type. Rows of type
    ``error`` name nobody. Line numbers are ordered but not dense."""
    raw = raw_calls(spark, sf, hourly)
    named = F.col("evidence_file_id") % 10 != EVENT_TYPES.index("error") + 1
    stamp = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = F.concat_ws(",", F.when(named, F.concat(F.lit('"'), F.left("caller", F.lit(4)), F.lit(" "),
                                                  F.substring("caller", 5, 20), F.lit('"'))).otherwise(F.lit("NA")),
                      F.lit('"a ""quoted"", note"'),
                      F.when(named, F.col("callee")).otherwise(F.lit("")),
                      F.when(named, F.col("imei")).otherwise(F.lit("null")),
                      stamp, F.when(named, F.col("ip")).otherwise(F.lit("")))
    keys = ["case_id", "evidence_file_id"]
    rows = raw.select(*keys, (F.col("rec_no") + 1).alias("line_no"), row.alias("value"))
    head = raw.select(*keys).distinct().select(
        *keys, F.lit(0).cast("long").alias("line_no"),
        F.lit("Calling-Number,Memo,B Party,Device IMEI,start_time,IP Address").alias("value"))
    return rows.unionByName(head).withColumn("bad_bytes", F.lit(False))


def ledger_files(spark: SparkSession, sf: str, header_only: bool = False) -> DataFrame:
    """Orders as ledger lines, one file per customer; every fifth file has no party column and, with
    ``header_only``, every seventh only a header (the files that are refused as empty)."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    row = F.concat_ws(",", F.concat(F.lit("acc "), _text("o_custkey")),
                      F.concat(F.lit("BR-"), _text(F.col("o_orderkey") % 1000)),
                      F.concat(F.lit("U"), _text("o_custkey"), F.lit("@Bank")),
                      F.concat(F.lit('"INR '), F.format_number("o_totalprice", 2), F.lit('"')),
                      F.date_format("o_orderdate", "dd/MM/yyyy"))
    rows = (orders.filter("o_custkey % 7 <> 0") if header_only else orders).select(
        F.col("o_custkey").alias("evidence_file_id"), (F.col("o_orderkey") + 1).alias("line_no"),
        row.alias("value"))
    head = orders.select("o_custkey").distinct().select(
        F.col("o_custkey").alias("evidence_file_id"), F.lit(0).cast("long").alias("line_no"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit("city,state,country,amt,date")).otherwise(
            F.lit("Remitter,beneficiary account,Payee-VPA,Txn Amount,Txn Date")).alias("value"))
    return rows.unionByName(head).select(
        F.lit(1).cast("long").alias("case_id"), "evidence_file_id", "line_no", "value",
        F.lit(False).alias("bad_bytes"))


def order_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as ledger lines, one file per order month and order status; those of status ``P`` have no
    party column."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    keys = [F.date_format("o_orderdate", "yyyyMM").cast("long").alias("case_id"),
            F.ascii("o_orderstatus").cast("long").alias("part")]
    row = F.concat_ws(",", F.concat(F.lit("acc "), _text("o_custkey")),
                      F.concat(F.lit("BR-"), _text(F.col("o_orderkey") % 1000)),
                      F.concat(F.lit("U"), _text("o_custkey"), F.lit("@Bank")),
                      F.concat(F.lit('"INR '), F.format_number("o_totalprice", 2), F.lit('"')),
                      F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = orders.select(*keys, (F.col("o_orderkey") + 1).alias("line_no"), row.alias("value"))
    head = orders.select(*keys, "o_orderstatus").distinct().select(
        "case_id", "part", F.lit(0).cast("long").alias("line_no"),
        F.when(F.col("o_orderstatus") == "P", F.lit("city,state,country,amt,date")).otherwise(
            F.lit("Remitter,beneficiary account,Payee-VPA,Txn Amount,Txn Date")).alias("value"))
    return rows.unionByName(head)


def supplier_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """One device dump per supplier: nested JSON, JSON with a list of phones, JSON without its last
    bracket, a text log, or JSON that names nothing."""
    key = _text("s_suppkey")
    imei, host = F.concat(F.lit("86"), F.lpad(key, 13, "0")), F.concat(
        F.lit("10.7."), _text(F.floor(F.col("s_suppkey") / 250)), F.lit("."), _text(F.col("s_suppkey") % 250))
    phone, other = (F.concat(F.lit(d), F.lpad(key, 9, "0")) for d in "97")
    plain = F.to_json(F.struct(F.struct(imei.alias("device_imei"), host.alias("host")).alias("meta"),
                               phone.alias("msisdn")))
    listed = F.to_json(F.struct(F.struct(F.array(phone, other).alias("phones")).alias("sim"), imei.alias("imei")))
    log = F.concat(F.lit("boot imei "), imei, F.lit("\n\nphone="), phone, F.lit(" up\nnothing here\n"))
    form = F.col("s_suppkey") % 5
    text = (F.when(form == 0, plain).when(form == 1, listed).when(form == 2, F.expr("left(p, length(p) - 1)"))
            .when(form == 3, log).otherwise(F.lit('{"note": "empty", "list": [1, 2]}')))
    return table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", plain.alias("p")).select(
        F.col("s_nationkey").cast("long").alias("case_id"), F.col("s_suppkey").alias("part"), F.lit(0).cast("long").alias("line_no"), text.alias("value"))


def mails(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as email artifacts, the text as body."""
    c = table(spark, sf, "conversations")
    conv = _text("conv_id")
    user = F.when(F.col("role") == "user", F.concat(F.lit("Caller."), conv)).otherwise(F.lit("Desk"))
    content = F.concat(
        F.lit('From: "Agent, '), F.col("role"), F.lit('" <'), user, F.lit("@Mail.Example>\r\nTo: a"), conv,
        F.lit("@x.example,\r\n\t<B@y.example>\r\nCC: copy@z.example\r\nMessage-ID: <"), conv, F.lit("."),
        _text("turn"), F.lit(">\r\nReceived: from h ([127.0.0.1])\r\n\tby m [10.9."),
        _text(F.col("conv_id") % 250), F.lit("."), _text("turn"),
        F.lit("]\r\nReceived: by edge (192.0.2.7)\r\nDate: Fri, 15 Mar 2024 10:15:00 +0530\r\n\r\n"),
        F.col("text"))
    return c.select(F.col("conv_id").alias("case_id"),
                    (F.col("conv_id") * 1000 + F.col("turn")).alias("evidence_file_id"),
                    content.cast("binary").alias("content"))


def json_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Call records as nested JSON device extractions."""
    raw = raw_calls(spark, sf)
    doc = F.struct(
        F.struct(F.col("imei").alias("device_imei"), F.col("ip").alias("assigned_host"),
                 F.col("caller").alias("subscriber_phone")).alias("meta"),
        F.array(F.struct(F.lit("com.sample.app").alias("package_name"), F.array(
            F.lit('say "hi" {now}'), F.concat(F.lit("peer "), F.col("ip"), F.lit(" via 198.51.100.9"))
        ).alias("notes"))).alias("installed"),
        F.concat(F.lit("02-00-00-00-00-"), F.lpad(_text(F.col("rec_no") % 100), 2, "0")).alias("wifi_mac"))
    return raw.select("case_id", F.col("rec_no").alias("evidence_file_id"), F.to_json(doc).alias("text"))
