"""Headline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import scalars as S
from barline.operators import joins, news
from barline.plans.registry import Tables, query
from barline.session import checkpoint_root
from barline.sources import files

ROW = "sha256(concat_ws('|', ticker, date, headline))"
LABELED = f"""labelled AS (SELECT row_id, max_by(signal, processed_at) AS signal, max_by(reasoning, processed_at) AS reasoning FROM (
  SELECT {ROW} AS row_id, CASE WHEN lower(raw_signal) IN ('buy','sell','neutral','error') THEN lower(raw_signal) ELSE 'neutral' END AS signal,
         concat('label ', raw_signal) AS reasoning, processed_at FROM news_labels) AS x GROUP BY row_id),
rows AS (SELECT {ROW} AS row_id, h.*, coalesce(l.signal, '') AS signal, coalesce(l.reasoning, '') AS reasoning
  FROM headlines AS h LEFT JOIN labelled AS l ON l.row_id = {ROW})"""


def _news(t: Tables):
    return files.as_news(t.headlines, {})


def _labels(t: Tables):
    raw = files.as_news(t.news_labels, {})
    return news.normalise_label(raw).withColumn("reasoning", F.concat(F.lit("label "), "raw_signal"))


def _labelled(t: Tables):
    cols = ["row_id", "signal", "reasoning", "processed_at"]
    rows = _labels(t).select(*cols)
    stored = rows.withColumns({"signal": F.lit("neutral"), "processed_at": F.lit(-1).cast("bigint")})
    return news.latest_labels(stored, rows)


def _rows(t: Tables):
    return news.with_labels(_news(t), _labelled(t))


@query("news_scan", "S1 C1 X1", f"SELECT line_no, headline, ticker, date, source, {ROW} AS row_id FROM headlines")
def _(t):
    return _news(t).select("line_no", "headline", "ticker", "date", "source", "row_id")


@query("news_csv_round_trip", "S1 S2 S15", f"SELECT headline, ticker, date, source, {ROW} AS row_id FROM headlines")
def _(t):
    path = f"{checkpoint_root(t.spark)}/news_csv/{t.dir.rstrip('/').split('/')[-1]}"
    files.write_csv(t.headlines.withColumnRenamed("headline", "title"), path, ["title", "ticker", "date", "source"])
    assert files.csv_columns(t.spark, path) == ["title", "ticker", "date", "source"]
    return files.read_news(t.spark, path, {"headline": "title"}).select("headline", "ticker", "date", "source", "row_id")


@query("news_ticker_search", "F1", "SELECT line_no, ticker, date FROM headlines WHERE regexp_matches(lower(ticker), 'rc1.?$')")
def _(t):
    return news.by_ticker(t.headlines, " RC1.?$ ").select("line_no", "ticker", "date")


@query("news_source_dates", "F2", "SELECT line_no, source, date FROM headlines WHERE source = 'en' AND date >= '2024-01-15' AND date <= '2024-03-01'")
def _(t):
    return news.by_source_and_date(t.headlines, "en", "2024-01-15", "2024-03-01").select("line_no", "source", "date")


@query("news_labels", "J1 S17 F26", f"WITH {LABELED} SELECT line_no, row_id, signal, reasoning FROM rows")
def _(t):
    return _rows(t).select("line_no", "row_id", "signal", "reasoning")


@query("news_label_store", "S17", f"WITH {LABELED} SELECT row_id, signal, reasoning FROM labelled")
def _(t):
    return _labelled(t).select("row_id", "signal", "reasoning")


@query("news_state_filter", "F3", f"WITH {LABELED} SELECT line_no, signal FROM rows WHERE signal = 'buy'")
def _(t):
    return news.by_state(_rows(t), "buy").select("line_no", "signal")


@query("news_unprocessed", "F3", f"WITH {LABELED} SELECT line_no FROM rows WHERE signal = ''")
def _(t):
    return news.by_state(_rows(t), "unprocessed").select("line_no")


@query("news_facets", "A5", "SELECT DISTINCT 'source' AS facet, source AS value FROM headlines UNION ALL SELECT DISTINCT 'ticker', ticker FROM headlines")
def _(t):
    return news.facets(t.headlines)


@query("news_totals", "A6", f"WITH {LABELED} SELECT count(*) AS total, count(*) FILTER (WHERE signal = '') AS unprocessed FROM rows WHERE source = 'en'")
def _(t):
    return news.totals(news.by_source_and_date(_rows(t), "en"))


@query("news_page", "T1", f"WITH {LABELED} SELECT line_no, row_id, ticker, date, source, signal FROM rows WHERE date >= '2024-01-10' ORDER BY line_no LIMIT 50 OFFSET 50")
def _(t):
    rows = news.by_source_and_date(_rows(t), start="2024-01-10")
    return news.page_of(rows, 2).select("line_no", "row_id", "ticker", "date", "source", "signal")


@query("news_label_answers", "F26", f"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'error' WHEN quality = 1 THEN 'buy' WHEN toxic = 1 THEN 'sell' ELSE 'neutral' END AS signal,
  CASE WHEN doc_id % 5 = 4 THEN '' ELSE concat('q', quality) END AS reasoning FROM labels""")
def _(t):
    word = F.when(F.col("quality") == 1, "BUY").when(F.col("toxic") == 1, "Sell").otherwise("strong hold")
    good = F.to_json(F.struct(word.alias("signal"), F.concat(F.lit("q"), "quality").alias("reason")))
    answers = t.labels.withColumn("response", F.when(F.col("doc_id") % 5 == 4, "{not json").otherwise(good))
    return news.parsed_labels(answers).select("doc_id", "signal", "reasoning")


@query("news_digest", "A35", """WITH top AS (SELECT ticker, line_no, headline, source, row_number() OVER (PARTITION BY ticker ORDER BY line_no) AS rn FROM headlines)
SELECT ticker, string_agg(concat('- ', headline, ': ', source), chr(10) ORDER BY rn) AS news_block,
       string_agg(CASE WHEN rn <= 8 THEN headline END, ' | ' ORDER BY rn) AS headlines, count(*) AS scored FROM top WHERE rn <= 28 AND headline <> '' GROUP BY ticker""")
def _(t):
    return news.digest(t.headlines.select("ticker", "line_no", F.col("headline").alias("title"), F.col("source").alias("summary")), items=28, titles=8)


@query("label_insert_or_ignore", "S16", f"""WITH stored AS (SELECT DISTINCT {ROW} AS row_id FROM news_labels)
SELECT row_id, min(line_no) AS line_no FROM (SELECT {ROW} AS row_id, line_no FROM headlines) AS h WHERE row_id NOT IN (SELECT row_id FROM stored) GROUP BY row_id""")
def _(t):
    incoming = _news(t).select("row_id", "line_no")
    return joins.insert_or_ignore(incoming, _labels(t), "row_id", ["line_no"])
