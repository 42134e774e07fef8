"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each statement is self-contained: the catalogue binding and the derived
request tables are CTEs over the driver's views, written independently of
the DataFrame code in ``tagrack.sources``.
"""

from __future__ import annotations

from ..functions.text import fold_sql

# Catalogue binding (FIXTURES.md §3), as CTEs.
BINDING = """
brand AS (
  SELECT CAST(substr(p_brand, 7) AS BIGINT) AS brand_id, p_brand AS name
    FROM (SELECT DISTINCT p_brand FROM part) b
  UNION ALL
  SELECT CAST(100000 + min(doc_id) AS BIGINT) AS brand_id, min_by(tok, doc_id) AS name
    FROM (SELECT doc_id, split_part(replace(text, chr(10), ' '), ' ', 1) AS tok FROM documents) d
   WHERE tok <> '' GROUP BY lower(tok)),
base_item AS (
  SELECT p_partkey AS base_item_id,
         CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name,
         concat(p_type, ' size ', CAST(p_size AS VARCHAR(10))) AS description,
         CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE CAST(substr(p_brand, 7) AS BIGINT) END AS brand_id,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey END AS thumbnail_image_id,
         CASE WHEN p_partkey % 53 = 0 THEN NULL
              ELSE CAST(CAST(p_partkey % 51 AS DECIMAL(4,1)) / 10 AS DECIMAL(2,1)) END AS rating
    FROM part),
image AS (
  SELECT p_partkey AS image_id, concat('img-', CAST(p_partkey AS VARCHAR(20)), '.jpg') AS url FROM part),
base_item_image AS (
  SELECT p_partkey AS base_item_id, p_partkey AS image_id FROM part WHERE p_partkey % 7 <> 0
  UNION ALL
  SELECT p_partkey AS base_item_id, p_partkey - 1 AS image_id FROM part WHERE p_partkey % 7 > 1),
tag_name AS (
  SELECT DISTINCT base_item_id, name FROM (
    SELECT p_partkey AS base_item_id, split_part(p_name, ' ', 1) AS name FROM part
    UNION ALL SELECT p_partkey, split_part(p_name, ' ', 2) FROM part
    UNION ALL SELECT p_partkey, lower(p_type) FROM part) t),
tag AS (
  SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS tag_id, name
    FROM (SELECT DISTINCT name FROM tag_name) t),
tag_item AS (
  SELECT t.tag_id, n.base_item_id FROM tag_name n JOIN tag t ON t.name = n.name),
sku AS (
  SELECT DISTINCT l_partkey * 10 + l_linenumber AS item_id, l_partkey AS base_item_id,
         CASE l_linenumber WHEN 1 THEN 'XS' WHEN 2 THEN 'S' WHEN 3 THEN 'M' WHEN 4 THEN 'L'
                           WHEN 5 THEN 'XL' WHEN 6 THEN 'XXL' END AS basic_size
    FROM lineitem),
stock_event AS (
  SELECT l_partkey * 10 + l_linenumber AS item_id,
         CASE WHEN l_returnflag = 'N' THEN 'ship-in' WHEN l_returnflag = 'R' THEN 'audit'
              WHEN l_linestatus = 'F' THEN 'ship-out' ELSE 'scrap' END AS transaction_event,
         CAST(l_quantity AS BIGINT) AS quantity, l_shipdate AS transaction_date,
         l_orderkey, l_suppkey, l_quantity, l_extendedprice
    FROM lineitem),
site_user AS (
  SELECT c_custkey AS site_user_id, 'Customer' AS first_name, substr(c_name, 10) AS last_name,
         c_name AS username, concat(replace(c_name, '#', '.'), '@example.com') AS email,
         c_mktsegment = 'MACHINERY' AS is_staff, c_custkey % 500 = 0 AS is_admin
    FROM customer),
closet AS (
  SELECT min(o_orderkey) AS closet_id, o_custkey AS site_user_id, o_orderpriority AS name,
         min(o_orderdate) AS created_at
    FROM orders GROUP BY o_custkey, o_orderpriority),
closet_item AS (
  SELECT c.closet_id, l.l_partkey AS item_id, min(l.l_shipdate) AS added_at
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
    JOIN closet c ON c.site_user_id = o.o_custkey AND c.name = o.o_orderpriority
   GROUP BY c.closet_id, l.l_partkey),
session_open AS (
  SELECT event_id AS session_id, user_id AS site_user_id,
         concat('tok-', CAST(event_id AS VARCHAR(20))) AS session_token, ts AS created_at
    FROM events WHERE event_type = 'signup'),
search_log AS (
  SELECT event_id, user_id, ts, concat(event_type, '-', CAST(event_id AS VARCHAR(20))) AS query
    FROM events)"""

FOLD = fold_sql


def with_binding(*ctes: str, body: str, recursive: bool = False) -> str:
    parts = [BINDING.strip()] + [c.strip() for c in ctes]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body.strip()


SQL: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    SQL[name] = sql


# ---------------------------------------------------------------------------
# Derived request tables (twins of tagrack.sources.requests)
W1 = "split_part(p.p_name, ' ', 1)"
W2 = "split_part(p.p_name, ' ', 2)"

BROWSE_REQ = f"""
browse_req AS (
  SELECT e.event_id AS request_id, CAST(e.event_id % 4 AS INT) AS page_index,
         CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE CAST(e.event_id % 7 * 10 AS INT) END AS items_per_page,
         CASE WHEN e.user_id % 7 = 0 THEN NULL
              WHEN e.user_id % 7 = 1 THEN [upper({W1})]
              WHEN e.user_id % 7 = 2 THEN [{W1}, upper({W1}), lower(p.p_type)]
              WHEN e.user_id % 7 = 3 THEN [{W1}, {W2}]
              WHEN e.user_id % 7 = 4 THEN [{W2}, NULL]
              WHEN e.user_id % 7 = 5 THEN ['No-Such-Tag']
              ELSE []::VARCHAR[] END AS include_tags
    FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id
   WHERE e.event_type = 'view')"""

HTTP_BROWSE_REQ = f"""
http_req AS (
  SELECT e.event_id AS request_id, CASE WHEN e.event_id % 10 = 3 THEN NULL ELSE coalesce({W1}, 'all') END AS path_tag,
         CASE WHEN e.user_id % 3 = 0 THEN []::VARCHAR[]
              ELSE [coalesce(lower(p.p_type), 'x')] END AS query_tags,
         CASE WHEN e.event_id % 6 = 0 THEN NULL WHEN e.event_id % 12 = 1 THEN 'x' WHEN e.event_id % 12 = 7 THEN '2x'
              WHEN e.event_id % 12 = 2 THEN '' WHEN e.event_id % 12 = 8 THEN ' 3'
              ELSE CAST(e.event_id % 4 AS VARCHAR) END AS page,
         CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE CAST(e.event_id % 7 * 20 AS VARCHAR) END AS page_size
    FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id
   WHERE e.event_type = 'view')"""

SEED_REQ = f"""
seed_req AS (
  SELECT e.event_id AS request_id,
         CASE WHEN e.event_id % 2 = 0 THEN lower(p.p_name) ELSE p.p_name END AS base_item_name,
         CASE WHEN e.event_id % 3 = 0 THEN upper(p.p_brand) ELSE p.p_brand END AS brand_name,
         CAST(CASE WHEN e.event_id % 7 = 0 THEN NULL WHEN e.event_id % 7 = 1 THEN -1
                   WHEN e.event_id % 7 = 2 THEN 1 ELSE 4 END AS INT) AS k
    FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id
   WHERE e.event_type = 'click')"""

SEARCH_REQ = f"""
search_req AS (
  SELECT e.event_id AS query_id,
         CASE WHEN e.event_id % 8 = 0 THEN substring({W1}, 2, 3)
              WHEN e.event_id % 8 = 1 THEN upper(substring({W2}, 1, 2))
              WHEN e.event_id % 8 = 2 THEN ''
              WHEN e.event_id % 8 = 3 THEN NULL
              WHEN e.event_id % 8 = 4 THEN concat(substring({W1}, 1, 1), '%', substring({W2}, 1, 1))
              WHEN e.event_id % 8 = 5 THEN 'É'
              WHEN e.event_id % 8 = 6 THEN concat('_', substring({W2}, 2, 2))
              WHEN e.event_id % 32 = 7 THEN concat(substring({W1}, 1, 1), '\\', substring({W1}, 2, 2))
              WHEN e.event_id % 32 = 15 THEN concat(substring({W2}, 1, 2), '\\')
              WHEN e.event_id % 64 = 23 THEN 'a\\%' WHEN e.event_id % 64 = 55 THEN '__'
              ELSE concat('  ', substring(p.p_brand, 1, 5), ' ') END AS q
    FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id
   WHERE e.event_type = 'error')"""

DETAIL_REQ = """
detail_req AS (
  SELECT e.event_id AS request_id,
         CASE WHEN e.event_id % 11 = 0 THEN NULL WHEN e.event_id % 11 = 1 THEN 'no such item'
              WHEN e.event_id % 2 = 0 THEN upper(p.p_name) ELSE p.p_name END AS base_item_name,
         CASE WHEN e.event_id % 5 = 0 THEN NULL WHEN e.event_id % 5 = 1 THEN lower(p.p_brand)
              WHEN e.event_id % 13 = 2 THEN 'Brand#999' ELSE p.p_brand END AS brand_name
    FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id
   WHERE e.event_type = 'purchase')"""

# ---------------------------------------------------------------------------
# Browse (U1-U4, D5): brute force per request, as the reference does.
BROWSE_CORE = """
req_tags AS (
  SELECT DISTINCT request_id, lower(t) AS tag_key
    FROM browse_req, unnest(coalesce(include_tags, []::VARCHAR[])) AS u(t)),
resolved AS (
  SELECT r.request_id, r.tag_key, t.tag_id FROM req_tags r LEFT JOIN tag t ON lower(t.name) = r.tag_key),
tag_counts AS (
  SELECT b.request_id, CAST(coalesce(c.n_in, 0) AS INT) AS n_in, CAST(coalesce(c.n_found, 0) AS INT) AS n_found
    FROM browse_req b LEFT JOIN (
      SELECT request_id, count(*) AS n_in, count(DISTINCT tag_id) AS n_found FROM resolved GROUP BY request_id) c
      USING (request_id)),
matched AS (
  SELECT c.request_id, bi.base_item_id FROM tag_counts c JOIN base_item bi ON TRUE WHERE c.n_in = 0
  UNION ALL
  SELECT r.request_id, ti.base_item_id
    FROM resolved r JOIN tag_counts c USING (request_id) JOIN tag_item ti ON ti.tag_id = r.tag_id
   WHERE c.n_in = c.n_found AND c.n_in > 0
   GROUP BY r.request_id, ti.base_item_id, c.n_in HAVING count(DISTINCT ti.tag_id) = c.n_in),
paging AS (
  SELECT request_id,
         CASE WHEN page_index IS NULL OR page_index < 1 THEN 1 ELSE page_index END AS page_index,
         CASE WHEN items_per_page IS NULL OR items_per_page < 1 THEN 24 ELSE items_per_page END AS items_per_page
    FROM browse_req)"""

register("resolve_tags", with_binding(BROWSE_REQ, BROWSE_CORE, body="""
SELECT request_id, n_in, n_found FROM tag_counts"""))

register("match_all_tags", with_binding(BROWSE_REQ, BROWSE_CORE, body="""
SELECT request_id, base_item_id FROM matched"""))

register("browse_totals", with_binding(BROWSE_REQ, BROWSE_CORE, body="""
SELECT p.request_id, CAST(coalesce(m.n, 0) AS INT) AS total_count,
       CAST(CASE WHEN coalesce(m.n, 0) = 0 THEN 0
                 ELSE (m.n + p.items_per_page - 1) // p.items_per_page END AS INT) AS total_pages
  FROM paging p LEFT JOIN (SELECT request_id, count(*) AS n FROM matched GROUP BY request_id) m
    USING (request_id)"""))

register("browse_page", with_binding(BROWSE_REQ, BROWSE_CORE, body="""
SELECT request_id, position, brand_name, item_name, description, thumbnail_url FROM (
  SELECT m.request_id, b.name AS brand_name, bi.name AS item_name, bi.description,
         img.url AS thumbnail_url, p.page_index, p.items_per_page,
         row_number() OVER (PARTITION BY m.request_id ORDER BY bi.base_item_id) AS position
    FROM matched m JOIN base_item bi USING (base_item_id) JOIN brand b ON b.brand_id = bi.brand_id
    LEFT JOIN image img ON img.image_id = bi.thumbnail_image_id
    JOIN paging p USING (request_id)) x
 WHERE position > (page_index - 1) * items_per_page AND position <= page_index * items_per_page"""))

register("browse_requests", with_binding(HTTP_BROWSE_REQ, body="""
SELECT request_id, status,
       CASE WHEN status = 'ok' THEN pg END AS page_index,
       CASE WHEN status = 'ok' THEN sz END AS items_per_page,
       CAST(len(tags) AS INTEGER) AS n_tags, array_to_string(tags, '|') AS tags
  FROM (SELECT request_id, pg, sz, CASE WHEN path_tag IS NULL THEN query_tags ELSE list_append(query_tags, path_tag) END AS tags,
               CASE WHEN pg IS NULL OR pg < 1 THEN 'bad_page'
                    WHEN sz IS NULL OR sz < 1 OR sz > 100 THEN 'bad_page_size' ELSE 'ok' END AS status
          FROM (SELECT *, TRY_CAST(regexp_extract(coalesce(nullif(page, ''), '1'), '^\\s*([+-]?[0-9]+)', 1) AS INT) AS pg,
                       TRY_CAST(regexp_extract(coalesce(nullif(page_size, ''), '20'), '^\\s*([+-]?[0-9]+)', 1) AS INT) AS sz FROM http_req) a) b"""))

# ---------------------------------------------------------------------------
# Related items (U5-U7): per seed, all candidates scored, as the reference does.
# From the meaning: lists of tags per item, and the length of their overlap.
RELATED_CORE = """
item_tag_list AS (
  SELECT base_item_id, list(DISTINCT tag_id) AS tags FROM tag_item GROUP BY base_item_id),
card AS (
  SELECT i.base_item_id, i.name AS item_name, lower(i.name) AS nk, b.name AS brand_name, lower(b.name) AS bk,
         t.url AS thumbnail_url
    FROM base_item i LEFT JOIN brand b USING (brand_id) LEFT JOIN image t ON t.image_id = i.thumbnail_image_id),
wish AS (
  SELECT request_id, lower(base_item_name) AS nk, lower(brand_name) AS bk, CASE WHEN k > 0 THEN k ELSE 0 END AS most
    FROM seed_req),
chosen AS (
  SELECT wish.request_id, wish.most, min(card.base_item_id) AS own
    FROM wish JOIN card USING (nk, bk) GROUP BY ALL),
common AS (
  SELECT chosen.request_id, chosen.most, other.base_item_id, len(list_intersect(mine.tags, other.tags)) AS n
    FROM chosen JOIN item_tag_list mine ON mine.base_item_id = chosen.own
    JOIN item_tag_list other ON other.base_item_id <> chosen.own
   WHERE chosen.most > 0),
similar_list AS (
  SELECT request_id, item_name, brand_name, thumbnail_url, CAST(n AS INT) AS shared_tag_count,
         row_number() OVER (PARTITION BY request_id ORDER BY n DESC, nk, item_name, base_item_id) AS rank
    FROM common JOIN card USING (base_item_id) WHERE n > 0 QUALIFY rank <= most),
from_brand AS (
  SELECT wish.request_id, card.item_name, card.brand_name, card.thumbnail_url,
         row_number() OVER (PARTITION BY wish.request_id ORDER BY card.nk, card.item_name, card.base_item_id) AS rank
    FROM wish JOIN card ON card.bk = wish.bk AND card.nk <> wish.nk QUALIFY rank <= most)"""

register("similar_items", with_binding(SEED_REQ, RELATED_CORE, body="""
SELECT request_id, CAST(rank AS INTEGER) AS rank, item_name, brand_name, thumbnail_url, shared_tag_count
  FROM similar_list"""))

register("more_from_brand", with_binding(SEED_REQ, RELATED_CORE, body="""
SELECT request_id, CAST(rank AS INTEGER) AS rank, item_name, brand_name, thumbnail_url FROM from_brand"""))

register("more_like", with_binding(SEED_REQ, RELATED_CORE, body="""
SELECT request_id, 'similar_items' AS kind, CAST(rank AS INTEGER) AS rank, item_name, brand_name, thumbnail_url
  FROM similar_list
UNION ALL
SELECT request_id, 'more_from_brand' AS kind, CAST(rank AS INTEGER) AS rank, item_name, brand_name, thumbnail_url
  FROM from_brand"""))

# ---------------------------------------------------------------------------
# Search and brand index
from ..model import INDEX_LETTERS  # noqa: E402

NAMES = f"""
fnamed AS (
  SELECT kind, name, name_id, {FOLD('name')} AS fname FROM (
    SELECT 'tags' AS kind, name, CAST(tag_id AS BIGINT) AS name_id FROM tag
    UNION ALL SELECT 'brands', name, CAST(brand_id AS BIGINT) FROM brand
    UNION ALL SELECT 'items', name, CAST(base_item_id AS BIGINT) FROM base_item) n)"""

# A user's backslash counts before backslash, % and _ only.
_LIKE = "regexp_replace({}, '(\\\\[\\\\%_])|\\\\(.)', '\\1\\2', 'gs')"
register("search_names", with_binding(SEARCH_REQ, NAMES, body=f"""
SELECT query_id, kind, CAST(rank AS INTEGER) AS rank, name FROM (
  SELECT q.query_id, n.kind, n.name,
         row_number() OVER (PARTITION BY q.query_id, n.kind
                            ORDER BY CASE WHEN ilike_escape(n.fname, q.starts, '\\') THEN 0 ELSE 1 END,
                                     n.fname, n.name, n.name_id) AS rank
    FROM (SELECT query_id, {_LIKE.format("'%' || fq || '%'")} AS contains, {_LIKE.format("fq || '%'")} AS starts
            FROM (SELECT query_id, {FOLD('q')} AS fq FROM search_req) f) q
    JOIN fnamed n ON ilike_escape(n.fname, q.contains, '\\')) x
 WHERE rank <= 5"""))

SQL["search_names_indexed"] = SQL["search_names"]
SQL["similar_items_indexed"] = SQL["similar_items"]

register("normalize_queries", with_binding(SEARCH_REQ, body=r"""
SELECT query_id, q FROM (
  SELECT query_id, regexp_replace(q, '^\s+|\s+$', '', 'g') AS q FROM search_req) x
 WHERE length(q) >= 1"""))

BRAND_INDEX = f"""
brand_initials AS (
  SELECT brand_id, name, fname,
         CASE WHEN regexp_matches(substring(fname, 1, 1), '^[0-9]') THEN '#'
              ELSE upper(substring(fname, 1, 1)) END AS initial
    FROM (SELECT brand_id, name, {FOLD('name')} AS fname FROM brand) b)"""

register("brand_index", with_binding(BRAND_INDEX, body="""
SELECT initial, row_number() OVER (PARTITION BY initial ORDER BY fname, name, brand_id) AS rank, name
  FROM brand_initials"""))

_LETTER_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(INDEX_LETTERS))
register("brand_index_letters", with_binding(BRAND_INDEX, body=f"""
SELECT l.letter_order, l.initial, CAST(count(b.brand_id) OVER (PARTITION BY l.initial) AS BIGINT) AS n_brands,
       CASE WHEN b.brand_id IS NOT NULL
            THEN row_number() OVER (PARTITION BY l.initial ORDER BY b.fname, b.name, b.brand_id) END AS rank, b.name
  FROM (VALUES {_LETTER_ROWS}) l(letter_order, initial) LEFT JOIN brand_initials b USING (initial)"""))

# ---------------------------------------------------------------------------
# Stock ledger
EV_ORDER = "transaction_date, l_orderkey, l_suppkey, l_quantity, l_extendedprice"
STOCK_CORE = f"""
ev AS (
  SELECT *, CASE WHEN transaction_event IN ('ship-out', 'scrap') THEN -quantity ELSE quantity END AS v,
         CASE WHEN transaction_event = 'audit' THEN 1 ELSE 0 END AS a
    FROM stock_event),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {EV_ORDER}) AS rn FROM ev),
last_audit AS (
  SELECT item_id, max(rn) FILTER (WHERE a = 1) AS last_a FROM ordered GROUP BY item_id),
closing AS (
  SELECT o.item_id,
         CAST(sum(o.v) FILTER (WHERE l.last_a IS NULL OR o.rn >= l.last_a) AS BIGINT) AS stock_quantity
    FROM ordered o JOIN last_audit l USING (item_id) GROUP BY o.item_id)"""

register("fold_stock_events", with_binding(STOCK_CORE, body=f"""
SELECT item_id, transaction_event, quantity, transaction_date, l_orderkey, l_suppkey, l_quantity,
       l_extendedprice, CAST(r AS BIGINT) AS stock_after,
       CAST(r - coalesce(lag(r) OVER (PARTITION BY item_id ORDER BY {EV_ORDER}), 0) AS BIGINT) AS delta_quantity
  FROM (SELECT *, sum(v) OVER (PARTITION BY item_id, s ORDER BY {EV_ORDER}
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
          FROM (SELECT *, sum(a) OVER (PARTITION BY item_id ORDER BY {EV_ORDER}
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
                  FROM ev) x) y"""))

register("stock_levels", with_binding(STOCK_CORE, body="SELECT item_id, stock_quantity FROM closing"))
register("apply_stock_events", with_binding(STOCK_CORE, body="SELECT item_id, stock_quantity FROM closing"))

register("validate_stock_events", with_binding(body="""
SELECT e.*, CASE WHEN e.transaction_event IS NULL
                   OR e.transaction_event NOT IN ('audit', 'ship-in', 'ship-out', 'scrap') THEN 'invalid_event'
                 WHEN e.quantity IS NULL THEN 'null_quantity'
                 WHEN e.transaction_event = 'audit' AND e.quantity < 0 THEN 'negative_audit'
                 WHEN NOT EXISTS (SELECT 1 FROM sku s WHERE s.item_id = e.item_id) THEN 'unknown_item'
                 ELSE 'ok' END AS status
  FROM (SELECT * REPLACE (
                 CASE l_orderkey % 41 WHEN 0 THEN NULL WHEN 1 THEN 'lost' ELSE transaction_event END AS transaction_event,
                 CASE l_orderkey % 41 WHEN 2 THEN NULL WHEN 3 THEN -quantity ELSE quantity END AS quantity,
                 CASE l_orderkey % 41 WHEN 4 THEN -item_id ELSE item_id END AS item_id)
          FROM stock_event) e"""))

# Raw events, told apart by the same checks; the valid ones folded as above.
RAW_EVENTS = """
raw_ev AS (
  SELECT e.*, CASE WHEN e.transaction_event IS NULL
                     OR e.transaction_event NOT IN ('audit', 'ship-in', 'ship-out', 'scrap') THEN 'invalid_event'
                   WHEN e.quantity IS NULL THEN 'null_quantity'
                   WHEN e.transaction_event = 'audit' AND e.quantity < 0 THEN 'negative_audit'
                   WHEN s.item_id IS NULL THEN 'unknown_item' ELSE 'ok' END AS status
    FROM (SELECT * REPLACE (
                   CASE l_orderkey % 41 WHEN 0 THEN NULL WHEN 1 THEN 'lost' ELSE transaction_event END AS transaction_event,
                   CASE l_orderkey % 41 WHEN 2 THEN NULL WHEN 3 THEN -quantity ELSE quantity END AS quantity,
                   CASE l_orderkey % 41 WHEN 4 THEN -item_id ELSE item_id END AS item_id)
            FROM stock_event) e LEFT JOIN sku s ON s.item_id = e.item_id)"""


def _folded(rows: str, opening: str) -> str:
    """Deltas of the valid events of ``rows`` after the stocks of ``opening``."""
    return f"""
folded AS (
  SELECT * EXCLUDE (v, a, seg, r, opened), CAST(r AS BIGINT) AS stock_after,
         CAST(r - coalesce(lag(r) OVER (PARTITION BY item_id ORDER BY {EV_ORDER}), opened) AS BIGINT) AS delta_quantity
    FROM (SELECT *, sum(v) OVER (PARTITION BY item_id, seg ORDER BY {EV_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    + CASE WHEN seg = 0 THEN opened ELSE 0 END AS r
            FROM (SELECT x.*, coalesce(o.stock_quantity, 0) AS opened,
                         CASE WHEN transaction_event IN ('ship-out', 'scrap') THEN -quantity ELSE quantity END AS v,
                         CASE WHEN transaction_event = 'audit' THEN 1 ELSE 0 END AS a,
                         sum(CASE WHEN transaction_event = 'audit' THEN 1 ELSE 0 END) OVER (
                           PARTITION BY x.item_id ORDER BY {EV_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg
                    FROM {rows} x LEFT JOIN {opening} o ON o.item_id = x.item_id WHERE x.status = 'ok') y) z)"""


_RAW_RESULT = """
SELECT * FROM folded
UNION ALL BY NAME SELECT *, CAST(NULL AS BIGINT) AS stock_after, CAST(NULL AS BIGINT) AS delta_quantity FROM {} WHERE status <> 'ok'"""

_BEFORE = """
{0} AS (
  SELECT item_id, CAST(sum(v) FILTER (WHERE last_a IS NULL OR rn >= last_a) AS BIGINT) AS stock_quantity
    FROM (SELECT *, max(rn) FILTER (WHERE a = 1) OVER (PARTITION BY item_id) AS last_a
            FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY """ + EV_ORDER + """) AS rn
                    FROM ev WHERE transaction_date < TIMESTAMP '{1}') x) y GROUP BY item_id)"""

register("apply_raw_stock_events", with_binding(
    STOCK_CORE, RAW_EVENTS, _BEFORE.format("before_cut", "1998-01-01"),
    "tail AS (SELECT * FROM raw_ev WHERE transaction_date >= TIMESTAMP '1998-01-01')",
    _folded("tail", "before_cut"), body=_RAW_RESULT.format("tail")))
register("stream_raw_stock_ledger", with_binding(
    RAW_EVENTS, "none AS (SELECT CAST(NULL AS BIGINT) AS item_id, CAST(NULL AS BIGINT) AS stock_quantity)",
    _folded("raw_ev", "none"), body=_RAW_RESULT.format("raw_ev")))
register("stock_levels_at", with_binding(STOCK_CORE, _BEFORE.format("then_levels", "1996-09-01"), body="SELECT * FROM then_levels"))

# ---------------------------------------------------------------------------
# Detail (U12-U16) and size rank
from ..model import SIZES  # noqa: E402

_SIZE_ROWS = ", ".join(f"('{s}', {i})" for i, s in enumerate(SIZES, start=1))
SIZES_CTE = f"basic_size AS (SELECT * FROM (VALUES {_SIZE_ROWS}) v(size, relative_order))"

DETAIL_CORE = """
first_brand AS (
  SELECT lower(bi.name) AS nk, min_by(b.name, bi.base_item_id) AS inferred
    FROM base_item bi JOIN brand b ON b.brand_id = bi.brand_id GROUP BY lower(bi.name)),
inferred AS (
  SELECT r.request_id, coalesce(r.brand_name, f.inferred) AS brand_name
    FROM detail_req r LEFT JOIN first_brand f ON f.nk = lower(r.base_item_name)),
per_key AS (
  SELECT lower(bi.name) AS nk, lower(b.name) AS bk, min(bi.base_item_id) AS id, count(*) AS n
    FROM base_item bi JOIN brand b ON b.brand_id = bi.brand_id GROUP BY lower(bi.name), lower(b.name)),
resolved AS (
  SELECT r.request_id, r.base_item_name, i.brand_name,
         CASE WHEN r.base_item_name IS NOT NULL AND i.brand_name IS NOT NULL THEN p.id END AS base_item_id,
         CASE WHEN r.base_item_name IS NULL THEN 'missing_name' WHEN i.brand_name IS NULL THEN 'no_brand'
              WHEN p.id IS NULL THEN 'missing' WHEN p.n > 1 THEN 'ambiguous' ELSE 'ok' END AS status
    FROM detail_req r JOIN inferred i USING (request_id)
    LEFT JOIN per_key p ON p.nk = lower(r.base_item_name) AND p.bk = lower(i.brand_name)),
images AS (
  SELECT bi.base_item_id, CAST(count(i.url) AS BIGINT) AS n_images,
         coalesce(string_agg(i.url, ',' ORDER BY i.image_id), '') AS image_urls
    FROM base_item bi LEFT JOIN (
      SELECT bii.base_item_id, im.image_id, im.url
        FROM base_item_image bii JOIN image im ON im.image_id = bii.image_id) i
      ON i.base_item_id = bi.base_item_id
   GROUP BY bi.base_item_id),
availability AS (
  SELECT s.base_item_id, s.basic_size, bs.relative_order, coalesce(c.stock_quantity, 0) > 0 AS in_stock
    FROM sku s JOIN basic_size bs ON upper(s.basic_size) = bs.size
    LEFT JOIN closing c ON c.item_id = s.item_id)"""

register("infer_brand", with_binding(DETAIL_REQ, DETAIL_CORE, body="SELECT request_id, brand_name FROM inferred"))
register("resolve_items", with_binding(DETAIL_REQ, DETAIL_CORE, body="""
SELECT request_id, base_item_name, brand_name, base_item_id, status FROM resolved"""))
register("item_images", with_binding(DETAIL_REQ, DETAIL_CORE, body="SELECT * FROM images"))
register("size_availability", with_binding(STOCK_CORE, SIZES_CTE, DETAIL_REQ, DETAIL_CORE, body="""
SELECT base_item_id, basic_size, relative_order, in_stock FROM availability"""))
register("seed_sizes", with_binding(SIZES_CTE, body="""
SELECT s.item_id, s.basic_size, bs.relative_order
  FROM sku s LEFT JOIN basic_size bs ON upper(s.basic_size) = bs.size"""))

DETAIL_SEEDS = """
seed_req AS (
  SELECT request_id, base_item_name, brand_name, 4 AS k FROM resolved WHERE status IN ('ok', 'ambiguous'))"""

register("item_detail", with_binding(STOCK_CORE, SIZES_CTE, DETAIL_REQ, DETAIL_CORE, DETAIL_SEEDS,
                                     RELATED_CORE, body="""
SELECT r.request_id, r.status, r.base_item_name AS item_name, r.brand_name, bi.description, bi.rating,
       im.image_urls,
       CASE WHEN bi.base_item_id IS NOT NULL THEN coalesce(sz.sizes, '') END AS sizes,
       CASE WHEN bi.base_item_id IS NOT NULL THEN coalesce(sm.l, '') END AS similar,
       CASE WHEN bi.base_item_id IS NOT NULL THEN coalesce(fb.l, '') END AS more_from_brand
  FROM resolved r
  LEFT JOIN base_item bi ON bi.base_item_id = r.base_item_id AND r.status IN ('ok', 'ambiguous')
  LEFT JOIN images im ON im.base_item_id = bi.base_item_id
  LEFT JOIN (SELECT base_item_id, string_agg(concat(basic_size, ':', CAST(in_stock AS VARCHAR)), '|'
                                             ORDER BY relative_order) AS sizes
               FROM availability GROUP BY base_item_id) sz ON sz.base_item_id = bi.base_item_id
  LEFT JOIN (SELECT request_id, string_agg(concat_ws('~', item_name, coalesce(brand_name, ''), coalesce(thumbnail_url, '')), '|' ORDER BY rank) AS l
               FROM similar_list GROUP BY request_id) sm ON sm.request_id = r.request_id
  LEFT JOIN (SELECT request_id, string_agg(concat_ws('~', item_name, coalesce(brand_name, ''), coalesce(thumbnail_url, '')), '|' ORDER BY rank) AS l
               FROM from_brand GROUP BY request_id) fb ON fb.request_id = r.request_id"""))

# ---------------------------------------------------------------------------
# Users, sessions, closets
from ..model import EMAIL_REGEX  # noqa: E402

AS_OF_SQL = "TIMESTAMP '2024-01-29 12:00:00'"
_EMAIL_SQL = EMAIL_REGEX.replace("'", "''")

SIGNUPS = """
signup_req AS (
  SELECT e.event_id AS seq, 'New' AS first_name, concat('User', CAST(e.user_id AS VARCHAR)) AS last_name,
         CASE WHEN e.event_id % 4 = 0 THEN c.c_name WHEN e.event_id % 4 = 1 THEN lower(c.c_name)
              WHEN e.event_id % 4 = 2 THEN concat('new-', CAST(e.user_id AS VARCHAR))
              ELSE concat('new-', CAST(e.event_id AS VARCHAR)) END AS username,
         CASE WHEN e.event_id % 5 = 0 THEN upper(concat(replace(c.c_name, '#', '.'), '@example.com'))
              WHEN e.event_id % 5 = 1 THEN 'not an email' WHEN e.event_id % 5 = 2 THEN NULL
              WHEN e.event_id % 5 = 3 THEN concat('u', CAST(e.event_id AS VARCHAR), '@example.org')
              ELSE concat('U', CAST(e.event_id // 40 AS VARCHAR), '@example.org') END AS email
    FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'signup')"""

# Sign-ups one by one in order of seq: a row clashes only with rows accepted
# before it, so the walk carries the accepted usernames and emails (as ranks).
SIGNUP_WALK = f"""
checked AS (
  SELECT s.*, CASE WHEN s.first_name IS NULL OR s.last_name IS NULL OR s.username IS NULL
                        OR s.email IS NULL THEN 'missing_field'
                   WHEN NOT regexp_matches(s.email, '{_EMAIL_SQL}') THEN 'bad_email'
                   WHEN EXISTS (SELECT 1 FROM site_user u WHERE u.username = s.username) THEN 'username_taken'
                   WHEN EXISTS (SELECT 1 FROM site_user u WHERE lower(u.email) = lower(s.email))
                     THEN 'email_taken' END AS refused
    FROM signup_req s),
queue AS (
  SELECT seq, row_number() OVER (ORDER BY seq) AS n, dense_rank() OVER (ORDER BY username) AS u,
         dense_rank() OVER (ORDER BY lower(email)) AS e
    FROM checked WHERE refused IS NULL),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, false AS ok,
         CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS es
  UNION ALL
  SELECT n, seq, ok, CASE WHEN ok THEN list_append(us, u) ELSE us END, CASE WHEN ok THEN list_append(es, e) ELSE es END
    FROM (SELECT q.n, q.seq, q.u, q.e, w.us, w.es,
                 NOT list_contains(w.us, q.u) AND NOT list_contains(w.es, q.e) AS ok
            FROM walk w JOIN queue q ON q.n = w.n + 1) x)"""

register("register_users", with_binding(SIGNUPS, SIGNUP_WALK, recursive=True, body="""
SELECT seq, status,
       CASE WHEN status = 'ok' THEN (SELECT max(site_user_id) FROM site_user)
            + row_number() OVER (PARTITION BY status = 'ok' ORDER BY seq) END AS site_user_id,
       CASE WHEN status = 'ok' THEN (SELECT max(closet_id) FROM closet)
            + row_number() OVER (PARTITION BY status = 'ok' ORDER BY seq) END AS favorites_closet_id
  FROM (SELECT c.seq, coalesce(c.refused, CASE WHEN w.ok THEN 'ok' ELSE 'duplicate_in_batch' END) AS status
          FROM checked c LEFT JOIN walk w ON w.seq = c.seq) b"""))

SESSIONS = """
sessions AS (
  SELECT session_id, site_user_id, session_token, created_at, created_at + INTERVAL 1 DAY AS expires_at
    FROM (SELECT *, row_number() OVER (PARTITION BY site_user_id
                                       ORDER BY created_at DESC, session_id DESC) AS rn
            FROM session_open) s WHERE rn = 1)"""

register("open_sessions", with_binding(SESSIONS, body="SELECT * FROM sessions"))

register("active_sessions", with_binding(SESSIONS, body=f"""
SELECT s.session_token, s.site_user_id, u.username, u.email, u.first_name, u.last_name, u.is_staff, u.is_admin
  FROM sessions s JOIN site_user u ON u.site_user_id = s.site_user_id
 WHERE s.expires_at > {AS_OF_SQL}
   AND (SELECT count(*) FROM sessions t WHERE t.session_token = s.session_token
                                          AND t.expires_at > {AS_OF_SQL}) = 1"""))

register("close_sessions", with_binding(SESSIONS, body="""
SELECT * FROM sessions s WHERE NOT EXISTS (
  SELECT 1 FROM events e WHERE e.event_type = 'error'
     AND concat('tok-', CAST(e.event_id - 1 AS VARCHAR)) = s.session_token)"""))

register("add_closets", with_binding(body=f"""
SELECT seq, status,
       CASE WHEN status = 'ok' THEN (SELECT max(closet_id) FROM closet)
            + row_number() OVER (PARTITION BY status = 'ok' ORDER BY seq) END AS closet_id
  FROM (SELECT a.seq,
               CASE WHEN u.site_user_id IS NULL THEN 'unknown_user'
                    WHEN EXISTS (SELECT 1 FROM closet c WHERE c.site_user_id = u.site_user_id
                                                          AND c.name = a.closet_name)
                      OR row_number() OVER (PARTITION BY u.site_user_id, a.closet_name ORDER BY a.seq) > 1
                    THEN 'duplicate' ELSE 'ok' END AS status
          FROM (SELECT e.event_id AS seq,
                       CASE WHEN e.event_id % 9 = 0 THEN 'nobody' ELSE c.c_name END AS username,
                       CASE WHEN e.event_id % 3 = 0 THEN '1-URGENT' WHEN e.event_id % 3 = 1 THEN 'Favorites'
                            ELSE concat('Wishlist ', CAST(e.event_id % 4 AS VARCHAR)) END AS closet_name
                  FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
                 WHERE e.event_type = 'purchase') a
          LEFT JOIN site_user u ON u.username = a.username) x"""))

register("remove_closets", with_binding(body="""
SELECT seq, status, CASE WHEN status = 'ok' THEN closet_id END AS closet_id
  FROM (SELECT r.seq, c.closet_id,
               CASE WHEN u.site_user_id IS NULL THEN 'unknown_user'
                    WHEN c.closet_id IS NULL THEN 'unknown_closet'
                    WHEN row_number() OVER (PARTITION BY c.closet_id ORDER BY r.seq) > 1 THEN 'unknown_closet'
                    ELSE 'ok' END AS status
          FROM (SELECT e.event_id AS seq, cu.c_name AS username,
                       CASE WHEN e.event_id % 3 = 0 THEN '5-LOW' WHEN e.event_id % 3 = 1 THEN '2-HIGH'
                            ELSE 'Nope' END AS closet_name
                  FROM events e LEFT JOIN customer cu ON cu.c_custkey = e.user_id
                 WHERE e.event_type = 'error') r
          LEFT JOIN site_user u ON u.username = r.username
          LEFT JOIN closet c ON c.site_user_id = u.site_user_id AND c.name = r.closet_name) x"""))

register("add_items_to_closets", with_binding(body="""
SELECT seq, status, closet_id, item_id FROM (
  SELECT a.seq, c.closet_id, k.item_id,
         CASE WHEN u.site_user_id IS NULL THEN 'unknown_user'
              WHEN c.closet_id IS NULL THEN 'unknown_closet'
              WHEN k.item_id IS NULL THEN 'unknown_item'
              WHEN EXISTS (SELECT 1 FROM closet_item ci WHERE ci.closet_id = c.closet_id AND ci.item_id = k.item_id)
                OR row_number() OVER (PARTITION BY c.closet_id, k.item_id ORDER BY a.seq) > 1
              THEN 'already_present' ELSE 'ok' END AS status
    FROM (SELECT e.event_id AS seq, cu.c_name AS username,
                 CASE e.event_id % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
                      WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' ELSE 'Nope' END AS closet_name,
                 lower(p.p_name) AS base_item_name,
                 CASE WHEN e.event_id % 10 = 0 THEN 'Brand#999' ELSE p.p_brand END AS brand_name
            FROM events e LEFT JOIN customer cu ON cu.c_custkey = e.user_id
            LEFT JOIN part p ON p.p_partkey = e.user_id
           WHERE e.event_type = 'click') a
    LEFT JOIN site_user u ON u.username = a.username
    LEFT JOIN closet c ON c.site_user_id = u.site_user_id AND c.name = a.closet_name
    LEFT JOIN (SELECT lower(bi.name) AS nk, lower(b.name) AS bk, min(bi.base_item_id) AS item_id
                 FROM base_item bi JOIN brand b ON b.brand_id = bi.brand_id
                GROUP BY lower(bi.name), lower(b.name)) k
      ON k.nk = lower(a.base_item_name) AND k.bk = lower(a.brand_name)) x"""))

register("user_closets", with_binding(body="""
SELECT u.username, c.closet_rank, c.name AS closet_name, i.item_rank, i.item_name, i.brand_name, i.thumbnail_url
  FROM site_user u
  LEFT JOIN (SELECT closet_id, site_user_id, name,
                    row_number() OVER (PARTITION BY site_user_id ORDER BY name, closet_id) AS closet_rank
               FROM closet) c ON c.site_user_id = u.site_user_id
  LEFT JOIN (SELECT ci.closet_id, bi.name AS item_name, b.name AS brand_name, img.url AS thumbnail_url,
                    row_number() OVER (PARTITION BY ci.closet_id
                                       ORDER BY lower(bi.name), bi.name, bi.base_item_id) AS item_rank
               FROM closet_item ci JOIN base_item bi ON bi.base_item_id = ci.item_id
               JOIN brand b ON b.brand_id = bi.brand_id
               LEFT JOIN image img ON img.image_id = bi.thumbnail_image_id) i ON i.closet_id = c.closet_id"""))

register("closet_item_counts", with_binding(body="""
SELECT c.closet_id, CAST(count(ci.item_id) AS BIGINT) AS n_items
  FROM closet c LEFT JOIN closet_item ci ON ci.closet_id = c.closet_id GROUP BY c.closet_id"""))

# ---------------------------------------------------------------------------
# Integrity and summaries
register("delete_base_items", with_binding(body="""
SELECT x.base_item_id, x.status,
       CASE WHEN x.status = 'ok' THEN (SELECT count(*) FROM base_item_image c WHERE c.base_item_id = x.base_item_id) ELSE 0 END AS n_images,
       CASE WHEN x.status = 'ok' THEN (SELECT count(*) FROM tag_item c WHERE c.base_item_id = x.base_item_id) ELSE 0 END AS n_tags,
       CASE WHEN x.status = 'ok' THEN (SELECT count(*) FROM sku c WHERE c.base_item_id = x.base_item_id) ELSE 0 END AS n_skus,
       CASE WHEN x.status = 'ok' THEN (SELECT count(*) FROM closet_item c WHERE c.item_id = x.base_item_id) ELSE 0 END AS n_closet_entries
  FROM (
    SELECT d.base_item_id,
           CASE WHEN NOT EXISTS (SELECT 1 FROM base_item bi WHERE bi.base_item_id = d.base_item_id) THEN 'missing'
                WHEN EXISTS (SELECT 1 FROM sku s JOIN stock_event l ON l.item_id = s.item_id
                              WHERE s.base_item_id = d.base_item_id) THEN 'restricted'
                ELSE 'ok' END AS status
      FROM (SELECT DISTINCT CASE WHEN event_id % 9 = 0 THEN -user_id ELSE user_id END AS base_item_id
              FROM events WHERE event_type = 'view') d) x"""))

DRAFTS = """
drafts AS (
  SELECT 1000000000000 + CAST(s_suppkey AS BIGINT) AS base_item_id, CAST(s_suppkey AS BIGINT) AS n FROM supplier),
draft_ids AS (
  SELECT DISTINCT unnest([base_item_id, 1000000000000 + abs(base_item_id)]) AS base_item_id
    FROM (SELECT CASE WHEN event_id % 9 = 0 THEN -user_id ELSE user_id END AS base_item_id FROM events WHERE event_type = 'view') d)"""

register("delete_draft_items", with_binding(DRAFTS, body="""
SELECT d.base_item_id,
       CASE WHEN f.n IS NOT NULL THEN 'ok' WHEN b.base_item_id IS NULL THEN 'missing'
            WHEN l.base_item_id IS NOT NULL THEN 'restricted' ELSE 'ok' END AS status,
       CASE WHEN f.n IS NULL AND b.base_item_id IS NOT NULL AND l.base_item_id IS NOT NULL THEN 'ledger.item_id' END AS refused_by,
       CASE WHEN f.n IS NOT NULL THEN (SELECT count(*) FROM image c WHERE c.image_id = f.n)
            WHEN b.base_item_id IS NOT NULL AND l.base_item_id IS NULL
            THEN (SELECT count(*) FROM base_item_image c WHERE c.base_item_id = d.base_item_id) ELSE 0 END AS n_images,
       CASE WHEN f.n IS NOT NULL THEN (SELECT count(*) FROM tag_item c WHERE c.base_item_id = f.n)
            WHEN b.base_item_id IS NOT NULL AND l.base_item_id IS NULL
            THEN (SELECT count(*) FROM tag_item c WHERE c.base_item_id = d.base_item_id) ELSE 0 END AS n_tags,
       CASE WHEN f.n % 2 = 0 THEN 1 ELSE 0 END AS n_skus,
       CASE WHEN f.n IS NOT NULL THEN (SELECT count(*) FROM closet c WHERE c.site_user_id = f.n)
            WHEN b.base_item_id IS NOT NULL AND l.base_item_id IS NULL
            THEN (SELECT count(*) FROM closet_item c WHERE c.item_id = d.base_item_id) ELSE 0 END AS n_closet_entries
  FROM draft_ids d LEFT JOIN drafts f USING (base_item_id) LEFT JOIN base_item b USING (base_item_id)
  LEFT JOIN (SELECT DISTINCT s.base_item_id FROM sku s JOIN stock_event e USING (item_id)) l USING (base_item_id)"""))

register("delete_images", with_binding(body="""
SELECT d.image_id,
       CASE WHEN i.image_id IS NULL THEN 'missing' WHEN t.id IS NOT NULL THEN 'restricted' ELSE 'ok' END AS status,
       CASE WHEN i.image_id IS NOT NULL AND t.id IS NOT NULL THEN 'base_item.thumbnail_image_id' END AS refused_by,
       CASE WHEN i.image_id IS NULL OR t.id IS NOT NULL THEN 0
            ELSE (SELECT count(*) FROM base_item_image c WHERE c.image_id = d.image_id) END AS n_item_images
  FROM (SELECT DISTINCT CASE WHEN event_id % 9 = 0 THEN -user_id ELSE user_id END AS image_id
          FROM events WHERE event_type = 'view') d
  LEFT JOIN image i USING (image_id)
  LEFT JOIN (SELECT DISTINCT thumbnail_image_id AS id FROM base_item) t ON t.id = d.image_id"""))

register("delete_tags", with_binding(body="""
SELECT d.tag_id, CASE WHEN t.tag_id IS NULL THEN 'missing' ELSE 'ok' END AS status, CAST(NULL AS VARCHAR) AS refused_by,
       (SELECT count(*) FROM tag_item c WHERE c.tag_id = d.tag_id) AS n_items
  FROM (SELECT DISTINCT CAST(user_id % 400 AS INT) AS tag_id FROM events WHERE event_type = 'click') d LEFT JOIN tag t USING (tag_id)"""))

register("delete_brands", with_binding(body="""
SELECT d.brand_id,
       CASE WHEN b.brand_id IS NULL THEN 'missing' WHEN i.brand_id IS NOT NULL THEN 'restricted' ELSE 'ok' END AS status,
       CASE WHEN b.brand_id IS NOT NULL AND i.brand_id IS NOT NULL THEN 'base_item.brand_id' END AS refused_by
  FROM (SELECT DISTINCT CAST(CASE WHEN event_id % 2 = 0 THEN user_id % 60 ELSE 100000 + user_id END AS BIGINT) AS brand_id
          FROM events WHERE event_type = 'error') d
  LEFT JOIN brand b USING (brand_id) LEFT JOIN (SELECT DISTINCT brand_id FROM base_item) i USING (brand_id)"""))

register("delete_users", with_binding(SESSIONS, body="""
SELECT d.site_user_id, CASE WHEN u.site_user_id IS NULL THEN 'missing' ELSE 'ok' END AS status, CAST(NULL AS VARCHAR) AS refused_by,
       CASE WHEN u.site_user_id IS NULL THEN 0
            ELSE (SELECT count(*) FROM sessions s WHERE s.site_user_id = d.site_user_id) END AS n_sessions,
       CASE WHEN u.site_user_id IS NULL THEN 0
            ELSE (SELECT count(*) FROM closet c WHERE c.site_user_id = d.site_user_id) END AS n_closets,
       CASE WHEN u.site_user_id IS NULL THEN 0
            ELSE (SELECT count(*) FROM closet c JOIN closet_item i USING (closet_id)
                   WHERE c.site_user_id = d.site_user_id) END AS n_closet_entries
  FROM (SELECT DISTINCT CASE WHEN event_id % 8 = 0 THEN -user_id ELSE user_id END AS site_user_id
          FROM events WHERE event_type = 'signup') d LEFT JOIN site_user u USING (site_user_id)"""))

register("rating_buckets", with_binding(body="""
SELECT brand_id, full_stars, half_star, 5 - full_stars - half_star AS empty_stars, count(*) AS n_items
  FROM (SELECT brand_id, CAST(floor(rating) AS INT) AS full_stars,
               CASE WHEN rating - floor(rating) >= 0.25 AND rating - floor(rating) < 0.75 THEN 1 ELSE 0 END
                 AS half_star
          FROM base_item WHERE rating IS NOT NULL) r
 GROUP BY brand_id, full_stars, half_star"""))

register("users_by_role", with_binding(body="""
SELECT CASE WHEN is_admin THEN 'Admin' WHEN is_staff THEN 'Staff' ELSE 'Member' END AS role, count(*) AS n_users
  FROM site_user GROUP BY 1"""))

# ---------------------------------------------------------------------------
# Feed ingest (U21-U29, D2): the feed's content computed straight from part.
FEED_CORE = """
fi AS (
  SELECT CAST(p_partkey // 48 + 1 AS INT) AS page, p_partkey AS k, p_size, p_brand,
         CAST(p_partkey AS VARCHAR) AS feed_item_id,
         CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS title,
         CASE WHEN p_partkey % 97 = 0 THEN 'Unknown Vendor'
              WHEN p_partkey % 89 = 0 THEN concat('Label ', CAST(p_partkey % 7 AS VARCHAR))
              WHEN p_partkey % 5 = 0 THEN upper(p_brand) ELSE p_brand END AS vendor,
         CAST(p_partkey % 23 AS DOUBLE) * 0.25 AS rating_raw,
         CASE WHEN p_partkey % 4 = 0 THEN concat('feed-', CAST(p_partkey AS VARCHAR), '-t.jpg')
              ELSE concat('img-', CAST(p_partkey AS VARCHAR), '.jpg') END AS thumbnail_image,
         CASE WHEN p_partkey % 6 = 0
                THEN [concat('feed-', CAST(p_partkey AS VARCHAR), '-a.jpg'), concat('feed-', CAST(p_partkey AS VARCHAR), '-b.jpg'),
                      concat('feed-', CAST(p_partkey AS VARCHAR), '-a.jpg')]
              WHEN p_partkey % 5 = 0
                THEN [concat('feed-', CAST(p_partkey AS VARCHAR), '-a.jpg'), concat('img-', CAST(p_partkey AS VARCHAR), '.jpg')]
              ELSE [concat('feed-', CAST(p_partkey AS VARCHAR), '-a.jpg'), concat('feed-', CAST(p_partkey AS VARCHAR), '-b.jpg')]
              END AS images
    FROM part),
fi_sizes AS (
  SELECT feed_item_id, k, 'XS' AS size, CAST(p_size % 3 AS BIGINT) AS count FROM fi
  UNION ALL SELECT feed_item_id, k, 'M', CAST(p_size % 4 AS BIGINT) FROM fi
  UNION ALL SELECT feed_item_id, k, 'L', 1 FROM fi WHERE k % 2 = 0
  UNION ALL SELECT feed_item_id, k, 's', 2 FROM fi WHERE k % 7 = 0
  UNION ALL SELECT feed_item_id, k, 'XXXXL', 1 FROM fi WHERE k % 11 = 0),
fi_tags AS (
  SELECT DISTINCT CAST(tn.base_item_id AS VARCHAR) AS feed_item_id,
         concat(upper(substring(t.name, 1, 1)), substring(t.name, 2)) AS tag_name
    FROM tag_name tn JOIN tag t ON t.name = tn.name
  UNION
  SELECT feed_item_id, concat('Size-', CAST(p_size % 5 AS VARCHAR)) FROM fi),
new_tags AS (
  SELECT (SELECT max(tag_id) FROM tag) + row_number() OVER (ORDER BY lower(name)) AS tag_id, name
    FROM (SELECT DISTINCT concat('Size-', CAST(p_size % 5 AS VARCHAR)) AS name FROM fi) s
   WHERE NOT EXISTS (SELECT 1 FROM tag t WHERE lower(t.name) = lower(s.name))),
all_tags AS (SELECT tag_id, name FROM tag UNION ALL SELECT tag_id, name FROM new_tags),
new_brands AS (
  SELECT (SELECT max(brand_id) FROM brand) + row_number() OVER (ORDER BY lower(name)) AS brand_id, name
    FROM (SELECT DISTINCT concat('Label ', CAST(k % 7 AS VARCHAR)) AS name FROM fi
           WHERE k % 89 = 0 AND k % 97 <> 0) s
   WHERE NOT EXISTS (SELECT 1 FROM brand b WHERE lower(b.name) = lower(s.name))),
all_brands AS (SELECT brand_id, name FROM brand UNION ALL SELECT brand_id, name FROM new_brands),
accepted AS (
  SELECT fi.*, TRY_CAST(rating_raw AS DECIMAL(2,1)) AS rating FROM fi
   WHERE TRY_CAST(rating_raw AS DECIMAL(2,1)) BETWEEN 0 AND 5),
new_images AS (
  SELECT (SELECT max(image_id) FROM image) + row_number() OVER (ORDER BY url) AS image_id, url
    FROM (SELECT thumbnail_image AS url FROM accepted UNION SELECT unnest(images) FROM accepted) u
   WHERE NOT EXISTS (SELECT 1 FROM image i WHERE i.url = u.url)),
all_images AS (SELECT image_id, url FROM image UNION ALL SELECT image_id, url FROM new_images),
new_items AS (
  SELECT a.feed_item_id, a.k,
         (SELECT max(base_item_id) FROM base_item) + row_number() OVER (ORDER BY a.page, a.k) AS base_item_id,
         a.title AS name, b.brand_id, im.image_id AS thumbnail_image_id, a.rating
    FROM accepted a LEFT JOIN all_brands b ON lower(b.name) = lower(a.vendor)
    LEFT JOIN all_images im ON im.url = a.thumbnail_image),
sku_rows AS (
  SELECT s.*, n.base_item_id, bs.relative_order,
         CASE WHEN n.base_item_id IS NULL THEN 'no_base_item'
              WHEN bs.relative_order IS NULL THEN 'unknown_size' END AS code
    FROM fi_sizes s LEFT JOIN new_items n USING (feed_item_id)
    LEFT JOIN basic_size bs ON bs.size = upper(s.size)),
new_skus AS (
  SELECT (SELECT max(item_id) FROM sku) + row_number() OVER (ORDER BY base_item_id, relative_order) AS item_id,
         base_item_id, size AS basic_size, feed_item_id, count
    FROM sku_rows WHERE code IS NULL)"""

_FEED = (SIZES_CTE, FEED_CORE)

register("parse_feed", with_binding(*_FEED, body="""
SELECT feed_item_id, page, title, vendor, rating_raw, CAST(len(images) AS INTEGER) AS n_images,
       CAST((SELECT count(*) FROM fi_sizes s WHERE s.k = fi.k) AS INT) AS n_sizes,
       CAST((SELECT count(DISTINCT name) FROM tag_name tn WHERE tn.base_item_id = fi.k) + 1
            + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS INT) AS n_tags
  FROM fi"""))

register("insert_if_absent", with_binding(*_FEED, body="""
SELECT 'tag' AS dim, CAST(tag_id AS INT) AS id, name FROM new_tags
UNION ALL SELECT 'brand', CAST(brand_id AS BIGINT), name FROM new_brands"""))

register("feed_item_tags", with_binding(*_FEED, body="SELECT feed_item_id, tag_name FROM fi_tags"))

register("add_base_items", with_binding(*_FEED, body="""
SELECT feed_item_id, CAST(base_item_id AS BIGINT) AS base_item_id, name, CAST(brand_id AS BIGINT) AS brand_id,
       CAST(thumbnail_image_id AS BIGINT) AS thumbnail_image_id, rating FROM new_items"""))

register("attach_images", with_binding(*_FEED, body="""
SELECT DISTINCT CAST(n.base_item_id AS BIGINT) AS base_item_id, CAST(im.image_id AS BIGINT) AS image_id
  FROM new_items n JOIN accepted a USING (feed_item_id)
  JOIN (SELECT feed_item_id, unnest(images) AS url FROM accepted) u USING (feed_item_id)
  JOIN all_images im ON im.url = u.url"""))

register("attach_tags", with_binding(*_FEED, body="""
SELECT DISTINCT CAST(t.tag_id AS INTEGER) AS tag_id, CAST(n.base_item_id AS BIGINT) AS base_item_id
  FROM new_items n JOIN fi_tags f USING (feed_item_id)
  JOIN all_tags t ON lower(t.name) = lower(f.tag_name)"""))

register("add_skus", with_binding(*_FEED, body="""
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(base_item_id AS BIGINT) AS base_item_id, basic_size,
       feed_item_id, count FROM new_skus"""))

register("opening_stock", with_binding(*_FEED, body="""
SELECT CAST(item_id AS BIGINT) AS item_id, 'audit' AS transaction_event, count AS quantity,
       count AS delta_quantity FROM new_skus"""))

_REJECTS = """
SELECT 'base_item' AS stage, feed_item_id, CAST(rating_raw AS VARCHAR) AS detail, 'bad_rating' AS code
  FROM fi WHERE NOT (TRY_CAST(rating_raw AS DECIMAL(2,1)) BETWEEN 0 AND 5)
UNION ALL
SELECT 'sku', feed_item_id, size, code FROM sku_rows WHERE code IS NOT NULL
UNION ALL
SELECT 'tag', feed_item_id, '9999', 'unknown_tag_id' FROM fi WHERE k % 13 = 0"""
register("ingest_feed", with_binding(*_FEED, body=_REJECTS))

register("feed_image_urls", with_binding(*_FEED, body="""
SELECT DISTINCT format('https://images.example.com/products/{}?profile=a', unnest(images)) AS url FROM fi"""))

# ---------------------------------------------------------------------------
# Streams (S1-S3) equal their batch twins.
SQL["stream_stock_ledger"] = SQL["fold_stock_events"]
register("stream_ingest", with_binding(*_FEED, body=_REJECTS + """
UNION ALL
SELECT 'item', NULL, concat_ws('|', n.name, coalesce(b.name, ''), CAST(n.rating AS VARCHAR), im.url,
         (SELECT count(DISTINCT u.url) FROM (SELECT feed_item_id, unnest(images) AS url FROM accepted) u
           WHERE u.feed_item_id = n.feed_item_id),
         coalesce(CAST(sk.skus AS VARCHAR), ''), coalesce(CAST(sk.stock AS VARCHAR), ''),
         (SELECT count(DISTINCT lower(f.tag_name)) FROM fi_tags f WHERE f.feed_item_id = n.feed_item_id)), 'added'
  FROM new_items n LEFT JOIN all_brands b USING (brand_id) LEFT JOIN all_images im ON im.image_id = n.thumbnail_image_id
  LEFT JOIN (SELECT base_item_id, count(*) AS skus, sum(count) AS stock FROM new_skus GROUP BY base_item_id) sk USING (base_item_id)"""))

DEBOUNCE_SQL = with_binding(body="""
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end,
       arg_max(query, (ts, event_id)) AS last_query, count(*) AS n_queries
  FROM (SELECT *, sum(new_burst) OVER (PARTITION BY user_id ORDER BY ts
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst
          FROM (SELECT user_id, ts, event_id, query,
                       CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR
                            THEN 0 ELSE 1 END AS new_burst
                  FROM search_log) s) b
 GROUP BY user_id, burst""")
register("stream_search_debounce", DEBOUNCE_SQL)
register("search_debounce", DEBOUNCE_SQL)

# ---------------------------------------------------------------------------
# Browse, normalised (request -> resolved tag set; tag set -> matched items)
REQUEST_TAGSETS = """
req_tagsets AS (
  SELECT c.request_id,
         CASE WHEN c.n_in = 0 THEN ''
              ELSE (SELECT array_to_string(list_sort(list(DISTINCT r.tag_id)), ',')
                      FROM resolved r WHERE r.request_id = c.request_id) END AS tagset_key
    FROM tag_counts c WHERE c.n_in = 0 OR c.n_in = c.n_found)"""

register("request_tagsets", with_binding(BROWSE_REQ, BROWSE_CORE, REQUEST_TAGSETS,
                                         body="SELECT request_id, tagset_key FROM req_tagsets"))
register("match_tagsets", with_binding(BROWSE_REQ, BROWSE_CORE, REQUEST_TAGSETS, body="""
SELECT DISTINCT t.tagset_key, m.base_item_id FROM req_tagsets t JOIN matched m USING (request_id)"""))


# ---------------------------------------------------------------------------
# Closets as they are asked for, sign-ins, committed commands
CLOSET_REQ = """
closet_req AS (
  SELECT e.event_id AS request_id,
         CASE WHEN e.event_id % 7 = 0 THEN lower(c.c_name) WHEN e.event_id % 11 = 0 THEN 'nobody' ELSE c.c_name END AS username
    FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'signup'),
asked_closets AS (
  SELECT r.request_id, r.username, u.site_user_id, c.closet_id, c.closet_rank, c.name AS closet_name, c.created_at,
         i.item_rank, i.item_name, i.brand_name, i.thumbnail_url, i.added_at
    FROM closet_req r LEFT JOIN site_user u ON u.username = r.username
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY site_user_id ORDER BY name, closet_id) AS closet_rank FROM closet) c
      ON c.site_user_id = u.site_user_id
    LEFT JOIN (SELECT ci.closet_id, ci.added_at, bi.name AS item_name, b.name AS brand_name, img.url AS thumbnail_url,
                      row_number() OVER (PARTITION BY ci.closet_id ORDER BY lower(bi.name), bi.name, bi.base_item_id) AS item_rank
                 FROM closet_item ci JOIN base_item bi ON bi.base_item_id = ci.item_id JOIN brand b ON b.brand_id = bi.brand_id
                 LEFT JOIN image img ON img.image_id = bi.thumbnail_image_id) i ON i.closet_id = c.closet_id)"""

register("closets_of_users", with_binding(CLOSET_REQ, body="""
SELECT request_id, username,
       CASE WHEN site_user_id IS NULL THEN 'unknown_user' WHEN closet_id IS NULL THEN 'no_closets'
            WHEN item_rank IS NULL THEN 'empty' ELSE 'item' END AS status,
       closet_id, closet_rank, closet_name, created_at, item_rank, item_name, brand_name, thumbnail_url, added_at
  FROM asked_closets"""))

_REMOVES = """
SELECT e.event_id AS seq, cu.c_name AS username,
       CASE WHEN e.event_id % 3 = 0 THEN '5-LOW' WHEN e.event_id % 3 = 1 THEN '2-HIGH' ELSE 'Nope' END AS closet_name
  FROM events e LEFT JOIN customer cu ON cu.c_custkey = e.user_id WHERE e.event_type = 'error'"""

register("remove_closets_entries", with_binding(body=f"""
SELECT seq, status, CASE WHEN status = 'ok' THEN closet_id END AS closet_id,
       CASE WHEN status = 'ok' THEN (SELECT count(*) FROM closet_item i WHERE i.closet_id = x.closet_id) ELSE 0 END AS n_entries
  FROM (SELECT r.seq, c.closet_id,
               CASE WHEN u.site_user_id IS NULL THEN 'unknown_user' WHEN c.closet_id IS NULL THEN 'unknown_closet'
                    WHEN row_number() OVER (PARTITION BY c.closet_id ORDER BY r.seq) > 1 THEN 'unknown_closet' ELSE 'ok' END AS status
          FROM ({_REMOVES}) r LEFT JOIN site_user u ON u.username = r.username
          LEFT JOIN closet c ON c.site_user_id = u.site_user_id AND c.name = r.closet_name) x"""))

register("sign_in", with_binding("""
login AS (
  SELECT l.seq, l.session_token, l.created_at, u.site_user_id
    FROM (SELECT e.event_id AS seq, concat('in-', CAST(e.event_id AS VARCHAR)) AS session_token, e.ts + INTERVAL 1 HOUR AS created_at,
                 CASE WHEN e.event_id % 6 = 1 THEN 'no@example.com' WHEN c.c_name IS NOT NULL THEN concat(replace(c.c_name, '#', '.'), '@example.com') END AS email
            FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'signup') l
    LEFT JOIN site_user u ON lower(u.email) = lower(l.email))""", body="""
SELECT session_id, site_user_id, session_token, created_at, created_at + INTERVAL 1 DAY AS expires_at, 'ok' AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY site_user_id ORDER BY created_at DESC, session_id DESC) AS rn
          FROM (SELECT session_id, site_user_id, session_token, created_at FROM session_open
                UNION ALL SELECT seq, site_user_id, session_token, created_at FROM login WHERE site_user_id IS NOT NULL) b) s
 WHERE rn = 1
UNION ALL SELECT seq, NULL, NULL, NULL, NULL, 'unknown_email' FROM login WHERE site_user_id IS NULL"""))

register("committed_closets", with_binding("""
closet_add AS (
  SELECT a.seq, u.site_user_id, a.closet_name
    FROM (SELECT e.event_id AS seq, CASE WHEN e.event_id % 9 = 0 THEN 'nobody' ELSE c.c_name END AS username,
                 CASE WHEN e.event_id % 3 = 0 THEN '1-URGENT' WHEN e.event_id % 3 = 1 THEN 'Favorites'
                      ELSE concat('Wishlist ', CAST(e.event_id % 4 AS VARCHAR)) END AS closet_name
            FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'purchase') a
    JOIN site_user u ON u.username = a.username),
closets_1 AS (
  SELECT closet_id, site_user_id, name FROM closet
  UNION ALL
  SELECT (SELECT max(closet_id) FROM closet) + row_number() OVER (ORDER BY seq), site_user_id, closet_name
    FROM (SELECT site_user_id, closet_name, min(seq) AS seq FROM closet_add GROUP BY ALL) f
   WHERE NOT EXISTS (SELECT 1 FROM closet c WHERE c.site_user_id = f.site_user_id AND c.name = f.closet_name)),
entries_1 AS (
  SELECT closet_id, item_id FROM closet_item
  UNION
  SELECT c.closet_id, k.item_id
    FROM (SELECT cu.c_name AS username, CASE e.event_id % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
                   WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' ELSE 'Nope' END AS closet_name,
                 lower(p.p_name) AS nk, lower(CASE WHEN e.event_id % 10 = 0 THEN 'Brand#999' ELSE p.p_brand END) AS bk
            FROM events e LEFT JOIN customer cu ON cu.c_custkey = e.user_id LEFT JOIN part p ON p.p_partkey = e.user_id
           WHERE e.event_type = 'click') a
    JOIN site_user u ON u.username = a.username
    JOIN closets_1 c ON c.site_user_id = u.site_user_id AND c.name = a.closet_name
    JOIN (SELECT lower(bi.name) AS nk, lower(b.name) AS bk, min(bi.base_item_id) AS item_id
            FROM base_item bi JOIN brand b ON b.brand_id = bi.brand_id GROUP BY 1, 2) k USING (nk, bk))""", body=f"""
SELECT c.closet_id, c.site_user_id, c.name, CAST(count(e.item_id) AS BIGINT) AS n_items
  FROM closets_1 c LEFT JOIN entries_1 e USING (closet_id)
 WHERE NOT EXISTS (SELECT 1 FROM ({_REMOVES}) r JOIN site_user u ON u.username = r.username
                    WHERE u.site_user_id = c.site_user_id AND r.closet_name = c.name)
   AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'signup' AND d.event_id % 8 <> 0 AND d.user_id = c.site_user_id)
 GROUP BY c.closet_id, c.site_user_id, c.name"""))

# ---------------------------------------------------------------------------
# The log in two waves: late rows apart, bursts over the rest
register("stream_search_debounce_late", with_binding("""
told AS (
  SELECT *, event_id % 20 = 3 AND ts < TIMESTAMP '2024-01-20' AND ts < (
           SELECT max(ts) - INTERVAL 2 DAY FROM search_log WHERE ts < TIMESTAMP '2024-01-20' AND event_id % 20 <> 3) AS late
    FROM search_log)""", body="""
SELECT 'burst' AS kind, user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end,
       arg_max(query, (ts, event_id)) AS last_query, count(*) AS n_queries
  FROM (SELECT *, sum(new_burst) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst
          FROM (SELECT user_id, ts, event_id, query,
                       CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new_burst
                  FROM told WHERE late IS NOT TRUE) s) b
 GROUP BY user_id, burst
UNION ALL SELECT 'late', user_id, ts, NULL, query, 1 FROM told WHERE late"""))

# ---------------------------------------------------------------------------
# A feed that comes again
register("ingest_feed_again", with_binding(*_FEED, body="""
SELECT feed_item_id, CASE WHEN (page - 1) % 3 = 0 THEN 'new' WHEN k % 10 = 0 THEN 'changed' ELSE 'same' END AS decision FROM accepted
UNION ALL
SELECT feed_item_id, 'bad_rating' FROM fi WHERE NOT (TRY_CAST(rating_raw AS DECIMAL(2,1)) BETWEEN 0 AND 5)
UNION ALL
SELECT feed_item_id, CASE WHEN TRY_CAST(rating_raw AS DECIMAL(2,1)) BETWEEN 0 AND 5 THEN 'repeated_id' ELSE 'bad_rating' END
  FROM fi WHERE k = (SELECT min(k) FROM fi f WHERE f.page = fi.page)
UNION ALL
SELECT NULL, 'bad_json' FROM (SELECT DISTINCT page FROM fi) p WHERE (page - 1) % 5 = 0"""))

# ---------------------------------------------------------------------------
# JSON documents, spelled out; a field without a value is left out.
register("search_documents", with_binding(SEARCH_REQ, body="""
SELECT q.query_id, concat('{"tags":', CAST(to_json(coalesce(list(h.name ORDER BY h.rank) FILTER (h.kind = 'tags'), [])) AS VARCHAR),
         ',"brands":', CAST(to_json(coalesce(list(h.name ORDER BY h.rank) FILTER (h.kind = 'brands'), [])) AS VARCHAR),
         ',"items":', CAST(to_json(coalesce(list(h.name ORDER BY h.rank) FILTER (h.kind = 'items'), [])) AS VARCHAR), '}') AS doc
  FROM search_req q LEFT JOIN (""" + SQL["search_names"] + """) h ON h.query_id = q.query_id GROUP BY q.query_id"""))

register("browse_documents", with_binding(BROWSE_REQ, body="""
SELECT t.request_id, concat('{"total_pages":', CAST(t.total_pages AS VARCHAR), ',"items":[', coalesce(string_agg(concat(
         '{"brand_name":', CAST(to_json(p.brand_name) AS VARCHAR), ',"item_name":', CAST(to_json(p.item_name) AS VARCHAR),
         ',"description":', CAST(to_json(p.description) AS VARCHAR),
         CASE WHEN p.thumbnail_url IS NOT NULL THEN concat(',"thumbnail_url":', CAST(to_json(p.thumbnail_url) AS VARCHAR)) ELSE '' END, '}'),
         ',' ORDER BY p.position) FILTER (p.position IS NOT NULL), ''), ']}') AS doc
  FROM (""" + SQL["browse_totals"] + """) t LEFT JOIN (""" + SQL["browse_page"] + """) p ON p.request_id = t.request_id
 GROUP BY t.request_id, t.total_pages"""))

register("index_documents", with_binding(BRAND_INDEX, body="""
SELECT initial, (rank - 1) // 100 AS block,
       concat('{', CAST(to_json(initial) AS VARCHAR), ':', CAST(to_json(list(name ORDER BY rank)) AS VARCHAR), '}') AS doc
  FROM (SELECT initial, name, row_number() OVER (PARTITION BY initial ORDER BY fname, name, brand_id) AS rank FROM brand_initials) r
 GROUP BY 1, 2"""))

register("closet_documents", with_binding(CLOSET_REQ, body="""
SELECT request_id, closet_rank, block, concat('{"closet_id":', CAST(closet_id AS VARCHAR), ',"name":', CAST(to_json(closet_name) AS VARCHAR),
         strftime(created_at, ',"created_at":"%Y-%m-%dT%H:%M:%S"'), ',"items":[', coalesce(string_agg(concat(
         '{"base_item_name":', CAST(to_json(item_name) AS VARCHAR), ',"brand_name":', CAST(to_json(brand_name) AS VARCHAR),
         CASE WHEN thumbnail_url IS NOT NULL THEN concat(',"thumbnail_url":', CAST(to_json(thumbnail_url) AS VARCHAR)) ELSE '' END,
         strftime(added_at, ',"added_at":"%Y-%m-%dT%H:%M:%S"'), '}'), ',' ORDER BY item_rank) FILTER (item_rank IS NOT NULL), ''), ']}') AS doc
  FROM (SELECT *, coalesce((item_rank - 1) // 20, 0) AS block FROM asked_closets WHERE closet_id IS NOT NULL) a
 GROUP BY request_id, closet_rank, block, closet_id, closet_name, created_at
UNION ALL
SELECT request_id, NULL, 0, CASE WHEN site_user_id IS NULL THEN '{"error":"unknown_user"}' ELSE '[]' END
  FROM asked_closets WHERE closet_id IS NULL"""))
