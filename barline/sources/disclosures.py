"""Landed disclosure payloads (JSON and HTML) to trade rows, and the committee reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import scalars as S

# ---- fixed values: accepted formats ----
TICKER = r"^[A-Z]{1,5}([.\-][A-Z])?$"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
HTML_TYPES = {"purchase": "buy", "sale": "sell"}

_ITEM = (
    "id string, politician string, ticker string, issuer string, txDate string, transactionDate string, "
    "transaction_date string, disclDate string, disclosureDate string, disclosure_date string, txType string, "
    "transactionType string, transaction_type string, amount string, amount_range string"
)
PAYLOAD = "data array<string>, trades array<string>"
TRADE = ["id", "politician", "ticker", "transaction_type", "transaction_date", "disclosure_date", "amount_range"]


def is_valid_trade() -> Column:
    return (
        F.coalesce(F.col("ticker"), F.lit("")).rlike(TICKER)
        & F.coalesce(F.col("transaction_date"), F.lit("")).rlike(ISO_DATE)
        & F.coalesce(F.col("disclosure_date"), F.lit("")).rlike(ISO_DATE)
        & (F.coalesce(F.col("id"), F.lit("")) != "")
    )


def _first(*names: str) -> Column:
    """First spelling that is present and not empty."""
    return F.coalesce(*[F.when(F.col(f"_i.{n}") != "", F.col(f"_i.{n}")) for n in names], F.lit(""))


def _nested(field: str, key: str) -> Column:
    raw = F.col(f"_i.{field}")
    return F.coalesce(F.when(raw.startswith("{"), F.get_json_object(raw, f"$.{key}")).otherwise(raw), F.lit(""))


def parse_json(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Trade rows with a ``valid`` flag; split on it to keep the rejects.

    Items are parsed one by one, so a malformed one spoils no other. It gives a row that is
    not valid, and so does a payload that cannot be read; both keep their text in ``raw``.
    """
    doc = payloads.withColumn("_d", F.from_json(column, PAYLOAD))
    items = F.when(F.size("_d.data") > 0, F.col("_d.data")).otherwise(F.col("_d.trades"))
    unread = F.col("_d.data").isNull() & F.col("_d.trades").isNull()
    items = F.when(unread, F.array(F.col(column))).otherwise(items)
    ticker = F.when(F.coalesce(F.col("_i.ticker"), F.lit("")) != "", F.col("_i.ticker")).otherwise(_nested("issuer", "ticker"))
    rows = doc.select(*[c for c in payloads.columns if c != column], F.explode(items).alias("raw"))
    rows = rows.withColumn("_i", F.from_json("raw", _ITEM))
    return rows.withColumns({
        "id": F.trim(F.coalesce("_i.id", F.lit(""))),
        "politician": _nested("politician", "name"),
        "ticker": S.normalize_ticker(ticker),
        "transaction_type": F.trim(F.lower(_first("txType", "transactionType", "transaction_type"))),
        "transaction_date": F.trim(_first("txDate", "transactionDate", "transaction_date")),
        "disclosure_date": F.trim(_first("disclDate", "disclosureDate", "disclosure_date")),
        "amount_range": F.trim(_first("amount", "amount_range")),
    }).drop("_i").withColumn("valid", is_valid_trade())


def _text(html: Column) -> Column:
    """Text of a cell: tags dropped, the common entities resolved, trimmed."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def parse_html(pages: DataFrame, column: str = "html") -> DataFrame:
    """Rows of ``table.q-table`` with at least seven cells, one row each, with a ``valid`` flag."""
    table = F.regexp_extract_all(column, F.lit(r"(?s)<table[^>]*class=\"[^\"]*\bq-table\b[^\"]*\"[^>]*>.*?</table>"), 0)
    rows = F.flatten(F.transform(table, lambda t: F.regexp_extract_all(t, F.lit(r"(?s)<tr\b.*?</tr>"), 0)))
    keep = [c for c in pages.columns if c != column]
    out = pages.select(*keep, F.explode(rows).alias("_r"))
    out = out.withColumn("_c", F.regexp_extract_all("_r", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1)).where(F.size("_c") >= 7)
    kind = F.lower(_text(F.col("_c")[3]))
    return out.select(
        *keep,
        F.trim(F.regexp_extract("_r", r"<tr[^>]*\bdata-id=\"([^\"]*)\"", 1)).alias("id"),
        _text(F.col("_c")[0]).alias("politician"),
        S.normalize_ticker(_text(F.col("_c")[2])).alias("ticker"),
        F.coalesce(F.try_element_at(S.literal_map(HTML_TYPES), kind), kind).alias("transaction_type"),
        _text(F.col("_c")[4]).alias("transaction_date"),
        _text(F.col("_c")[5]).alias("disclosure_date"),
        _text(F.col("_c")[6]).alias("amount_range"),
    ).withColumn("valid", is_valid_trade())


def snapshot_items(docs: DataFrame, column: str = "payload") -> DataFrame:
    """A cached snapshot is an object with ``trades`` or a bare list; both give items."""
    item = "array<struct<" + _ITEM.replace(" string", ":string") + ">>"
    listed = F.from_json(column, item)
    wrapped = F.from_json(column, f"trades {item}")["trades"]
    pick = F.when(F.ltrim(column).startswith("["), listed).otherwise(wrapped)
    return docs.select(F.explode(pick).alias("_i")).select("_i.*")


def committee_members(legislators: DataFrame, committees: DataFrame, membership: DataFrame) -> DataFrame:
    """Nested reference files to (name, committees): sub-committee ids are parent id + own id."""
    people = legislators.select(F.col("id.bioguide").alias("bio"), F.col("name.official_full").alias("name")).where(
        "bio <> '' AND name <> ''"
    )
    top = committees.where("thomas_id <> '' AND name <> ''")
    subs = top.select("thomas_id", F.explode("subcommittees").alias("s")).where("s.thomas_id <> '' AND s.name <> ''")
    titles = top.select("thomas_id", F.col("name").alias("committee")).unionByName(
        subs.select(F.concat("thomas_id", "s.thomas_id").alias("thomas_id"), F.col("s.name").alias("committee"))
    )
    seats = membership.select("thomas_id", F.explode("members").alias("m")).select("thomas_id", F.col("m.bioguide_id").alias("bio"))
    return (
        seats.join(titles, "thomas_id").join(people, "bio")
        .groupBy(F.lower("name").alias("name")).agg(F.array_sort(F.collect_set("committee")).alias("committees"))
    )
