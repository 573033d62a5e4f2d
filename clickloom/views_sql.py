"""SQL text of the views of ``clickloom.views`` (same rows, for the side-by-side check)."""

from __future__ import annotations

import re

HOUR_MS = 3600000
DAY_MS = 86400000
LOG_START_MS = 1465876799998

VIEWS: dict[str, str] = {
    "imp0": "SELECT l_orderkey AS display_id, l_partkey AS ad_id, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2",
    "impressions": """SELECT display_id, ad_id, price, CAST(CASE WHEN row_number() OVER
        (PARTITION BY display_id ORDER BY price DESC, ad_id) = 1 THEN 1 ELSE 0 END AS INTEGER) AS clicked FROM imp0""",
    "split_ids": """SELECT display_id, CASE WHEN row_number() OVER (ORDER BY md5('1234:' || CAST(display_id AS VARCHAR)), display_id)
        <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'valid' END AS part
        FROM (SELECT DISTINCT display_id FROM impressions) t""",
    "split_impressions": "SELECT i.*, s.part FROM impressions i JOIN split_ids s USING (display_id)",
    "impressions_train": "SELECT display_id, ad_id, price, clicked FROM split_impressions WHERE part = 'train'",
    "impressions_test": "SELECT display_id, ad_id FROM split_impressions WHERE part = 'valid'",
    "display_events": """SELECT o_orderkey AS display_id, o_custkey AS uuid,
        o_orderkey % (SELECT count(*) FROM documents) AS document_id,
        epoch_us(o_orderdate) // 1000 - (SELECT min(epoch_us(o_orderdate) // 1000) FROM orders) AS ts,
        CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS INTEGER) AS platform,
        CASE r_name WHEN 'AMERICA' THEN 'US' WHEN 'EUROPE' THEN 'GB' WHEN 'ASIA' THEN 'CA' ELSE r_name END
          || '>' || n_name || '>' || c_mktsegment AS geo_location
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "events_derived": f"""SELECT *, split_part(geo_location, '>', 1) AS country,
        CASE WHEN split_part(geo_location, '>', 1) IN ('US', 'CA', 'GB') THEN split_part(geo_location, '>', 1)
          ELSE 'Rest' END AS country_group,
        CAST(1 + CAST(floor(ts / {HOUR_MS}.0) AS BIGINT) % 24 AS INTEGER) AS hour,
        CAST(1 + floor(ts / {DAY_MS}.0) AS INTEGER) AS day FROM display_events""",
    "promoted": """SELECT p_partkey AS ad_id, p_partkey % (SELECT count(*) FROM documents) AS document_id,
        p_type AS campaign_id, p_brand AS advertiser_id FROM part""",
    "doc_meta": """SELECT doc_id AS document_id, source AS source_id, lang AS publisher_id,
        CASE WHEN doc_id % 7 = 0 THEN '' ELSE
          strftime(DATE '1999-06-01' + CAST(doc_id AS INTEGER), '%Y-%m-%d') || ' 00:00:00' END AS publish_time
        FROM documents""",
    "doc_meta_derived": f"""SELECT document_id, source_id, publisher_id,
        CASE WHEN year(p) BETWEEN 2001 AND 2016 THEN epoch_us(p) // 1000 - {LOG_START_MS} END AS publish_ts
        FROM (SELECT *, CAST(nullif(publish_time, '') AS TIMESTAMP) AS p FROM doc_meta) t""",
    "page_views": """SELECT user_id AS uuid, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS document_id,
        epoch_us(ts) // 1000 - (SELECT min(epoch_us(ts) // 1000) FROM events) AS ts,
        CAST(event_id % 3 + 1 AS INTEGER) AS platform,
        list_extract(['US', 'CA', 'GB', 'ES', 'MX'], user_id % 5 + 1) || '>S' || CAST(user_id % 10 AS VARCHAR) AS geo_location,
        CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS INTEGER) AS traffic_source FROM events""",
    "wide": """SELECT i.display_id, i.ad_id, i.clicked, e.uuid, e.document_id, e.ts, e.platform, e.geo_location, e.country,
        e.country_group, e.hour, e.day, m.source_id, m.publisher_id, m.publish_ts,
        p.document_id AS ad_document_id, p.campaign_id AS ad_campaign_id, p.advertiser_id AS ad_advertiser_id,
        a.source_id AS ad_source_id, a.publisher_id AS ad_publisher_id, a.publish_ts AS ad_publish_ts
        FROM impressions i JOIN events_derived e USING (display_id) JOIN promoted p ON p.ad_id = i.ad_id
        JOIN doc_meta_derived m ON m.document_id = e.document_id
        JOIN doc_meta_derived a ON a.document_id = p.document_id""",
    "ad_rate": "SELECT ad_id, sum(clicked) / (count(*) + 4.0) AS prob FROM impressions GROUP BY 1",
    "scores": """SELECT i.display_id, i.ad_id, i.clicked, r.prob, CAST((e.day - 1) % 13 + 1 AS INTEGER) AS day
        FROM impressions i JOIN ad_rate r USING (ad_id) JOIN events_derived e USING (display_id)""",
    "doc_words": """SELECT doc_id AS document_id, word FROM
        (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) t WHERE word <> ''""",
}

for _kind, _expr in {"topic": "left(word, 2)", "entity": "word", "category": "left(word, 1)"}.items():
    VIEWS[f"types_{_kind}"] = f"""SELECT document_id, {_expr} AS type_id,
        CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY document_id) AS confidence_level
        FROM doc_words GROUP BY 1, 2"""


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it mentions, directly or through other views."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text))
        for name, sql in known.items():
            if name in words and name not in order:
                visit(sql)
                order.append(name)

    visit(body)
    ctes = [f"{name} AS ({known[name]})" for name in order]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
