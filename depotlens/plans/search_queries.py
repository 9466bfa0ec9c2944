"""Search, paging, ranking and mode comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.functions.scalar import iso_instant
from depotlens.operators import paging, ranking, search
from depotlens.operators.search import Criteria
from depotlens.plans.registry import query
from depotlens.plans.source_queries import scratch
from depotlens.sources import curve, tables, views
from depotlens.sources.tables import inventory

COLUMNS = ["warehouse_id", "item_id", "item_name", "quantity", "lot_number", "location", "unit_price"]
SELECT = "SELECT " + ", ".join(COLUMNS) + " FROM inventory"

TOKYO = "warehouse_id = 'WH-TOKYO'"
NAME_RED_RING = "list_has_any(string_split_regex(lower(item_name), '[^\\p{L}\\p{N}]+'), ['red', 'ring'])"
FIVE = Criteria("WH-TOKYO", "ITEM#BRA-", "A-", "red ring", 905, 990, 50, 900)
FIVE_SQL = f"""{TOKYO} AND starts_with(item_id, 'ITEM#BRA-') AND starts_with(location, 'A-')
    AND {NAME_RED_RING} AND unit_price BETWEEN 905 AND 990 AND quantity BETWEEN 50 AND 900"""


def written_view(spark, sf, axis: str) -> views.OrderedView:
    """The stock written in the order of one axis into a new shared folder."""
    path = scratch(spark, "view")
    views.write_ordered_view(inventory(spark, sf), path, axis)
    return views.OrderedView(spark, path, axis)


@query("flt_1_warehouse", f"{SELECT} WHERE {TOKYO}", "inventory")
def _(spark, sf):
    return search.search(inventory(spark, sf), Criteria(warehouse_id="WH-TOKYO"))


@query("flt_2_point_lookups", """
    SELECT k.warehouse_id, k.item_id, k.request_id, i.quantity IS NOT NULL AS found,
      coalesce(i.quantity, -1) AS quantity
    FROM (SELECT l.l_orderkey AS request_id, ['WH-TOKYO','WH-OSAKA','WH-FUKUOKA'][l.l_suppkey % 3 + 1]
        AS warehouse_id, 'ITEM#' || ['ETH','BRA','COL','GTM','KEN','IDN','CRI','TZA','BLEND','DRIP',
        'MAT'][l.l_partkey % 11 + 1] || '-' || lpad((l.l_partkey + l.l_linenumber)::VARCHAR, 12, '0')
        AS item_id FROM lineitem l) k
    LEFT JOIN inventory i ON i.warehouse_id = k.warehouse_id AND i.item_id = k.item_id""", "inventory")
def _(spark, sf):
    line = tables.load(spark, sf, "lineitem")
    keys = line.select(
        F.col("l_orderkey").alias("request_id"),
        tables._pick(("WH-TOKYO", "WH-OSAKA", "WH-FUKUOKA"), F.col("l_suppkey")).alias("warehouse_id"),
        F.concat(
            F.substring_index(tables._item_id(F.col("l_partkey")), "-", 1), F.lit("-"),
            F.lpad((F.col("l_partkey") + F.col("l_linenumber")).cast("string"), 12, "0"),
        ).alias("item_id"),
    )
    return search.get_items(inventory(spark, sf), keys).select(
        "warehouse_id", "item_id", "request_id", "found",
        F.coalesce("quantity", F.lit(-1).cast("bigint")).alias("quantity"),
    )


@query("flt_3_item_prefix", f"{SELECT} WHERE {TOKYO} AND starts_with(item_id, 'ITEM#ETH-')", "inventory")
def _(spark, sf):
    return search.search(inventory(spark, sf), Criteria("WH-TOKYO", item_prefix="ITEM#ETH-"))


@query("flt_4_location_prefix", f"{SELECT} WHERE {TOKYO} AND starts_with(location, 'D-')", "inventory")
def _(spark, sf):
    return search.search(inventory(spark, sf), Criteria("WH-TOKYO", location_prefix="D-"))


@query("flt_5_price_range", f"{SELECT} WHERE {TOKYO} AND unit_price BETWEEN 910 AND 920", "inventory")
def _(spark, sf):
    return search.search(inventory(spark, sf), Criteria("WH-TOKYO", min_price=910, max_price=920))


@query("flt_6_quantity_range", f"{SELECT} WHERE quantity >= 900", "inventory")
def _(spark, sf):
    return search.search(inventory(spark, sf), Criteria(min_quantity=900))


@query("flt_7_name_substring", f"{SELECT} WHERE contains(item_name, 'd r')", "inventory")
def _(spark, sf):
    rows = inventory(spark, sf)
    return rows.filter(Criteria(item_name="d r").conditions("capped")["item_name"])


@query("flt_8_name_tokens", f"{SELECT} WHERE {NAME_RED_RING}", "inventory")
def _(spark, sf):
    return search.search(inventory(spark, sf), Criteria(item_name="Red RING"))


@query("flt_8_document_tokens", """
    SELECT doc_id, lang, n_chars FROM documents
    WHERE list_has_any(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), ['nicht', 'aile'])""")
def _(spark, sf):
    docs = tables.load(spark, sf, "documents")
    return docs.filter(search.match_any("text", "nicht, Aile")).select("doc_id", "lang", "n_chars")


@query("flt_9_all_criteria", f"{SELECT} WHERE {FIVE_SQL}", "inventory")
def _(spark, sf):
    raw = {
        "warehouse_id": " WH-TOKYO ", "item_prefix": "ITEM#BRA-", "location_prefix": "A-",
        "item_name": "red ring", "min_price": "905", "max_price": "990", "min_quantity": "50",
        "max_quantity": "900",
    }
    return search.search(inventory(spark, sf), Criteria.parse(raw))


@query("flt_9_curve_ranges", f"""
    {SELECT} WHERE unit_price BETWEEN 905 AND 990 AND quantity BETWEEN 50 AND 900 AND location LIKE 'A-%'""", "inventory")
def _(spark, sf):
    """Several ranges at once, over the files of the Z-order layout that they meet."""
    path = scratch(spark, "curve")
    curve.write_curve_view(inventory(spark, sf), path)
    wanted = Criteria(location_prefix="A-", min_price=905, max_price=990, min_quantity=50, max_quantity=900)
    return curve.CurveView(spark, path).search(wanted)


@query("flt_9_no_criteria", SELECT, "inventory")
def _(spark, sf):
    raw = {"warehouse_id": "  ", "min_price": "cheap", "max_quantity": ""}
    return search.search(inventory(spark, sf), Criteria.parse(raw))


@query("flt_9_criteria_table", """
    SELECT event_id, nullif(trim(event_type), 'view') AS label,
      CASE WHEN isnan(n) THEN NULL ELSE n END AS number
    FROM (SELECT *, TRY_CAST(nullif(trim(json_extract_string(props, '$.k')), '') AS DOUBLE) AS n
          FROM events) parsed""")
def _(spark, sf):
    from depotlens.functions.scalar import parse_number, parse_text

    return tables.load(spark, sf, "events").select(
        "event_id",
        F.nullif(parse_text(F.col("event_type")), F.lit("view")).alias("label"),
        parse_number(F.get_json_object("props", "$.k")).alias("number"),
    )


@query("flt_10_all_warehouses", f"{SELECT} WHERE {NAME_RED_RING}", "inventory")
def _(spark, sf):
    return search.search(inventory(spark, sf), Criteria(warehouse_id=None, item_name="red ring"))


@query("flt_10_capped_without_warehouse", f"""
    SELECT *, 'capped search needs a warehouse: every ordered view is kept per warehouse' AS note
    FROM ({SELECT} WHERE false) none""", "inventory")
def _(spark, sf):
    found = search.capped_search(inventory(spark, sf), Criteria(item_name="red"))
    return found.rows.withColumn("note", F.lit(found.note))


@query("flt_11_list_by_price", f"""{SELECT} WHERE {TOKYO} AND unit_price BETWEEN 910 AND 915
    ORDER BY unit_price DESC, item_id DESC LIMIT 20""", "inventory")
def _(spark, sf):
    return search.list_inventory(
        inventory(spark, sf), "WH-TOKYO", "good", "unitPrice", min_price=910, max_price=915, order="desc"
    ).rows


@query("flt_11_list_fallback", f"{SELECT} WHERE {TOKYO} ORDER BY item_id LIMIT 20", "inventory")
def _(spark, sf):
    return search.list_inventory(
        inventory(spark, sf), "WH-TOKYO", "goodGsi", "unitPrice", min_price=910
    ).rows


CAPPED = Criteria("WH-OSAKA", location_prefix="B-", min_quantity=100, max_quantity=700)


@query("flt_12_capped_page", f"""
    SELECT *, 'byLocation' AS used_view, 'quantity BETWEEN 100 AND 700' AS filters,
      'quantity range is applied after the page was read' AS note
    FROM ({SELECT} WHERE warehouse_id = 'WH-OSAKA' AND starts_with(location, 'B-')
          ORDER BY location, item_id LIMIT 20) page
    WHERE quantity BETWEEN 100 AND 700""", "inventory")
def _(spark, sf):
    found = search.capped_search(inventory(spark, sf), CAPPED)
    return found.rows.withColumns({
        "used_view": F.lit(found.view), "filters": F.lit(", ".join(found.filters)),
        "note": F.lit(found.note),
    })


@query("flt_12_capped_page_from_views", f"""
    {SELECT.replace("FROM inventory", "")} FROM (SELECT * FROM inventory
      WHERE warehouse_id = 'WH-OSAKA' AND unit_price >= 903 ORDER BY unit_price, item_id LIMIT 20) page
    WHERE contains(item_name, 'r')""", "inventory")
def _(spark, sf):
    criteria = Criteria("WH-OSAKA", item_name="r", min_price=903)
    found = search.capped_search_views({"unit_price": written_view(spark, sf, "unit_price")}, criteria)
    return found.rows.select(COLUMNS)


@query("flt_13_log_grep", """
    SELECT conv_id, turn, role, text FROM conversations WHERE regexp_matches(text, '[0-9]{2,}|nicht')
    ORDER BY conv_id DESC, turn DESC, role DESC, text DESC LIMIT 50""")
def _(spark, sf):
    talk = tables.load(spark, sf, "conversations")
    return search.grep_log(talk, "text", "[0-9]{2,}|nicht", ["conv_id", "turn", "role", "text"])


@query("flt_14_any_of", f"""{SELECT} WHERE (starts_with(item_id, 'ITEM#KEN-') AND unit_price >= 950)
    OR (warehouse_id = 'WH-OSAKA' AND quantity <= 60)""", "inventory")
def _(spark, sf):
    return search.search_any(inventory(spark, sf), [
        Criteria(item_prefix="ITEM#KEN-", min_price=950),
        Criteria(warehouse_id="WH-OSAKA", max_quantity=60),
    ])


@query("flt_15_relational", f"""{SELECT} WHERE {TOKYO} AND contains(item_name, 'ring')
    AND quantity BETWEEN 10 AND 800 ORDER BY quantity DESC, item_id LIMIT 50 OFFSET 5""", "inventory")
def _(spark, sf):
    rows = inventory(spark, sf).filter(F.col("warehouse_id") == "WH-TOKYO")
    return search.relational_search(
        rows, {"item_name": "ring"}, {"quantity": (10, 800)}, [F.desc("quantity"), F.asc("item_id")],
        limit=50, offset=5,
    )


_COMPLETE = f"SELECT warehouse_id, item_id FROM inventory WHERE {TOKYO} AND {NAME_RED_RING}"
_CAPPED = f"""SELECT warehouse_id, item_id FROM (SELECT * FROM inventory WHERE {TOKYO}
    ORDER BY item_id LIMIT 20) page WHERE contains(item_name, 'red ring')"""


@query("join_1_mode_presence", f"""
    SELECT coalesce(c.warehouse_id, p.warehouse_id) AS warehouse_id, coalesce(c.item_id, p.item_id) AS item_id,
      c.item_id IS NOT NULL AS in_complete, p.item_id IS NOT NULL AS in_capped
    FROM ({_COMPLETE}) c FULL OUTER JOIN ({_CAPPED}) p
      ON c.item_id = p.item_id AND c.warehouse_id = p.warehouse_id""", "inventory")
def _(spark, sf):
    return search.compare_modes(inventory(spark, sf), Criteria("WH-TOKYO", item_name="red ring"))


@query("join_1_mode_summary", f"""
    SELECT count(*) AS complete_hits, count(*) FILTER (in_capped) AS capped_hits,
      count(*) FILTER (in_capped) AS in_both,
      round(count(*) FILTER (in_capped)::DOUBLE / count(*), 6) AS recall
    FROM (SELECT item_id, item_id IN (SELECT item_id FROM ({_CAPPED}) p) AS in_capped
          FROM ({_COMPLETE}) c) marked""", "inventory")
def _(spark, sf):
    criteria = Criteria("WH-TOKYO", item_name="red ring")
    return search.mode_summary(search.compare_modes(inventory(spark, sf), criteria))


@query("join_2_key_coverage", """
    SELECT count(*) AS probe_keys, count(*) FILTER (pooled) AS covered_keys,
      round(count(*) FILTER (pooled)::DOUBLE / count(*), 6) AS covered_share
    FROM (SELECT item_id, item_id IN (SELECT item_id FROM movements WHERE type = 'ship') AS pooled
          FROM (SELECT DISTINCT item_id FROM inventory) probe) met""", "inventory movements")
def _(spark, sf):
    pool = tables.movements(spark, sf).filter(F.col("type") == "ship")
    return search.coverage(inventory(spark, sf), pool, ["item_id"])


@query("pag_1_ordered_page", f"{SELECT} WHERE {TOKYO} ORDER BY unit_price DESC, item_id DESC LIMIT 20",
       "inventory")
def _(spark, sf):
    rows = inventory(spark, sf).filter(F.col("warehouse_id") == "WH-TOKYO")
    return paging.ordered_page(rows, "unit_price", order="desc").rows


@query("pag_1_page_from_views", f"""{SELECT} WHERE {TOKYO} AND starts_with(location, 'C-')
    ORDER BY location DESC, item_id DESC LIMIT 20""", "inventory")
def _(spark, sf):
    stored = {"location": written_view(spark, sf, "location")}
    return search.list_inventory_views(
        stored, "WH-TOKYO", "good", "location", prefix="C-", order="desc"
    ).rows.select(COLUMNS)


_CURSOR_SQL = """translate(rtrim(base64(encode('{"unit_price":' || unit_price || ',"item_id":"' || item_id
    || '","warehouse_id":"' || warehouse_id || '"}')), '='), '+/', '-_')"""


@query("pag_2_cursor_second_page", f"""
    SELECT p.*, t.next_token FROM (
      {SELECT} WHERE {TOKYO} ORDER BY unit_price, item_id LIMIT 20 OFFSET 20) p,
      (SELECT {_CURSOR_SQL} AS next_token FROM (
        {SELECT} WHERE {TOKYO} ORDER BY unit_price, item_id LIMIT 1 OFFSET 39) last) t""", "inventory")
def _(spark, sf):
    rows = inventory(spark, sf).filter(F.col("warehouse_id") == "WH-TOKYO")
    first = paging.ordered_page(rows, "unit_price")
    second = paging.ordered_page(rows, "unit_price", token=first.next_token())
    return second.with_token()


@query("pag_3_offset_page", f"""{SELECT} WHERE {FIVE_SQL.split('AND starts_with(item_id')[0]}
    ORDER BY item_id, warehouse_id LIMIT 20 OFFSET 40""", "inventory")
def _(spark, sf):
    rows = search.search(inventory(spark, sf), Criteria("WH-TOKYO"))
    return paging.offset_page(rows, ["item_id", "warehouse_id"], 40, 20)


@query("pag_3_deep_offset_page", f"""{SELECT} ORDER BY quantity, item_id, warehouse_id
    LIMIT 20 OFFSET 500""", "inventory")
def _(spark, sf):
    return paging.offset_page(inventory(spark, sf), ["quantity", "item_id", "warehouse_id"], 500, 20, top_k_depth=100)


@query("pag_4_page_info", f"""
    SELECT count(*) AS total, 3::BIGINT AS page_number, greatest(1, (count(*) + 19) // 20) AS page_count
    FROM inventory WHERE {TOKYO} AND {NAME_RED_RING}""", "inventory")
def _(spark, sf):
    found = search.search(inventory(spark, sf), Criteria("WH-TOKYO", item_name="red ring"))
    return paging.page_info(found, 40, 20)


_WALK = f"""SELECT (row_number() OVER (ORDER BY unit_price, item_id) - 1) // 20 + 1 AS page,
    contains(item_name, 'red') AND starts_with(location, 'C-') AS hit
    FROM inventory WHERE {TOKYO} AND unit_price >= 905"""
WALKED = Criteria("WH-TOKYO", item_name="red", location_prefix="C-", min_price=905)


@query("pag_5_capped_walk", f"""
    SELECT page, count(*) AS rows_read, count(*) FILTER (hit) AS hits FROM ({_WALK}) w GROUP BY page""",
    "inventory")
def _(spark, sf):
    return paging.capped_walk(inventory(spark, sf), WALKED)


@query("pag_5_walk_summary", f"""
    SELECT count(*) AS pages, coalesce(sum(hits), 0)::BIGINT AS hits, count(*) FILTER (hits > 0) AS pages_with_hits,
      coalesce(max(page) FILTER (hits > 0), 0) AS pages_until_all
    FROM (SELECT page, count(*) FILTER (hit) AS hits FROM ({_WALK}) w GROUP BY page) pages""", "inventory")
def _(spark, sf):
    return paging.walk_summary(paging.capped_walk(inventory(spark, sf), WALKED))


def bm25_sql(table: str, key: str, text: str, terms: list[str], k: int) -> str:
    """Textbook BM25 over one text column, tokens counted in SQL."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
    WITH words AS (SELECT {key}, list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'),
          lambda w: w <> '') AS w FROM {table}),
    counted AS (SELECT {key}, len(w)::DOUBLE AS length, w FROM words),
    collection AS (SELECT count(*) AS n, avg(length) AS mean_length FROM counted),
    hits AS (SELECT {key}, length, term, len(list_filter(w, lambda x: x = term)) AS tf
      FROM counted, (SELECT unnest([{listed}]) AS term) q),
    freq AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM hits GROUP BY term)
    SELECT {key}, round(sum(ln(1.0 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
        / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))), 6) AS score
    FROM hits JOIN freq USING (term), collection WHERE tf > 0
    GROUP BY {key} ORDER BY score DESC, {key} LIMIT {k}"""


@query("pag_6_relevance_documents", bm25_sql("documents", "doc_id", "text", ["nicht", "aile", "the"], 50))
def _(spark, sf):
    docs = tables.load(spark, sf, "documents")
    return ranking.ranked_search(docs, "doc_id", "text", "nicht aile the", 50)


@query("pag_6_relevance_items", bm25_sql("part", "p_partkey", "p_name", ["red", "gizmo"], 20))
def _(spark, sf):
    return ranking.ranked_search(tables.load(spark, sf, "part"), "p_partkey", "p_name", "Red gizmo", 20)


_RELEVANCE_SQL = """WITH words AS (SELECT *, list_filter(string_split_regex(lower(item_name), '[^\\p{L}\\p{N}]+'),
          lambda w: w <> '') AS w FROM inventory),
    counted AS (SELECT *, len(w)::DOUBLE AS length FROM words),
    collection AS (SELECT count(*) AS n, avg(length) AS mean_length FROM counted),
    hits AS (SELECT warehouse_id, item_id, length, term, len(list_filter(w, lambda x: x = term)) AS tf
      FROM counted, (SELECT unnest(['red', 'ring']) AS term) q),
    freq AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM hits GROUP BY term),
    scores AS (SELECT warehouse_id, item_id,
        round(sum(ln(1.0 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
        / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))), 6) AS score
      FROM hits JOIN freq USING (term), collection WHERE tf > 0 GROUP BY ALL)"""


@query("pag_6_relevance_page", f"""{_RELEVANCE_SQL}
    SELECT i.*, score, count(*) OVER () AS total FROM inventory i JOIN scores USING (warehouse_id, item_id)
    WHERE {TOKYO} AND unit_price BETWEEN 905 AND 990 ORDER BY score DESC, item_id, warehouse_id LIMIT 20 OFFSET 5""",
    "inventory")
def _(spark, sf):
    """Best matches of a name under other criteria, from the sixth row on."""
    wanted = Criteria("WH-TOKYO", item_name="red ring", min_price=905, max_price=990)
    return ranking.relevance_search(inventory(spark, sf), wanted, start=5)


@query("pag_7_run_history", """
    SELECT execution_id, variant, strftime(started_at, '%Y-%m-%dT%H:%M:%S.000Z') AS started_at,
      substr(execution_id, 1, 8) || '…' AS short_id FROM runs ORDER BY started_at DESC, execution_id DESC""",
    "runs")
def _(spark, sf):
    from depotlens.functions.scalar import short_id

    newest = paging.history(tables.runs(spark, sf))
    return newest.select(
        "execution_id", "variant", iso_instant(F.col("started_at")).alias("started_at"),
        short_id(F.col("execution_id")).alias("short_id"),
    )


@query("fmt_display_columns", """
    SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS instant,
      '¥' || format('{:,}', event_id * 37) AS price,
      translate(rtrim(base64(encode('{"user_id":' || user_id || ',"event_type":"' || event_type || '"}')), '='),
        '+/', '-_') AS token
    FROM events""")
def _(spark, sf):
    from depotlens.functions import scalar

    return tables.load(spark, sf, "events").select(
        "event_id", scalar.clock(F.col("ts")).alias("clock"),
        scalar.iso_instant(F.col("ts")).alias("instant"),
        scalar.yen(F.col("event_id") * 37).alias("price"),
        scalar.encode_token(F.struct("user_id", "event_type")).alias("token"),
    )
