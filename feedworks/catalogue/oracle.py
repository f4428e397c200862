"""What each query must return, said independently in DuckDB SQL."""

from __future__ import annotations

AS_OF = "DATE '2002-01-01'"
# The header below and the error codes in the rules.
HEADER = (
    "|H|Member_Name|Member_Id|Enrollment_Date|Last_Flight_Date|Tier_Code|"
    "Agent_Name|State|Country|DOB|Is_Active"
)

# --- derived inputs -----------------------------------------------------------------

MEMBER_PATH = """'incoming/member/profile_'
      || CASE WHEN k%173=0 THEN 'undated' ELSE strftime(od, '%Y%m%d') END
      || '.txt'"""
MEMBER_DAY = "CASE WHEN k%173=0 THEN NULL ELSE od END"
# The same in files of a month.
FILE_DAY = "CASE WHEN k%173=0 THEN NULL ELSE last_day(od) END"
MEMBER_FILE = f"""CASE WHEN k%173=0 THEN 'profile-' WHEN month(od)%3=1 THEN 'profile [1]{{a}}*-'
      WHEN month(od)%3=2 THEN 'profile 100%41-' ELSE 'profile-' END
      || lpad(CAST(k // 131072 AS VARCHAR), 6, '0') || '_'
      || coalesce(strftime({FILE_DAY}, '%Y%m%d'), 'undated') || '.txt'"""

LINES = f"""
source AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS od,
         c_name, c_nationkey % 5 AS nation, c_mktsegment,
         DATE '1950-01-01' + CAST((o_custkey * 17) % 18000 AS INTEGER) AS birth
  FROM orders JOIN customer ON o_custkey = c_custkey
),
sent AS (
  SELECT *,
    CASE WHEN k%101=0 THEN 'X' ELSE 'D' END AS f1,
    CASE WHEN k%61=0 THEN '' WHEN k%67=0 THEN repeat('x', 300) ELSE c_name END AS f2,
    CASE WHEN k%71=0 THEN '' WHEN k%73=0 THEN 'A' || c
         ELSE CAST(c AS VARCHAR) END AS f3,
    CASE WHEN k%79=0 THEN '20241301' WHEN k%83=0 THEN ''
         WHEN k%89=0 THEN '20990101'
         ELSE strftime(od - CAST(k % 3000 AS INTEGER), '%Y%m%d') END AS f4,
    CASE WHEN k%97=0 THEN '20240230' WHEN k%109=0 THEN '20990101'
         WHEN k%113=0 THEN '19000101' WHEN k%5=0 THEN ''
         ELSE strftime(od, '%Y%m%d') END AS f5,
    CASE WHEN k%139=0 THEN 'PLATINUM' ELSE left(c_mktsegment, 3) END AS f6,
    CASE WHEN k%149=0 THEN repeat('y', 300) ELSE 'Agent' || (k % 10) END AS f7,
    CASE WHEN k%151=0 THEN 'TOOLONG' ELSE 'S' || (k % 50) END AS f8,
    CASE WHEN k%157=0 THEN ''
         ELSE CASE nation WHEN 0 THEN 'USA' WHEN 1 THEN 'ind' WHEN 2 THEN 'AUS'
              WHEN 3 THEN 'PHL' ELSE 'CAN' END END AS f9,
    CASE WHEN k%127=0 THEN '19851303' WHEN k%131=0 THEN '20990101'
         WHEN k%137=0 THEN '18000101'
         WHEN k%2=0 THEN strftime(birth, '%m%d%Y')
         ELSE strftime(birth, '%Y%m%d') END AS f10,
    CASE WHEN k%163=0 THEN 'Z' WHEN k%3=0 THEN 'A' WHEN k%3=1 THEN 'i'
         ELSE '' END AS f11
  FROM source
),
lines AS (
  SELECT
    {MEMBER_PATH} AS source_path,
    CASE WHEN k%107=0 THEN '{HEADER}' WHEN k%103=0 THEN '|H|WRONG'
         ELSE '|' || f1 || '|' || f2 || '|' || f3 || '|' || f4 || '|' || f5
              || '|' || f6 || '|' || f7 || '|' || f8 || '|' || f9 || '|' || f10
              || '|' || f11 || CASE WHEN k%167=0 THEN '|extra' ELSE '' END
    END AS raw_record,
    {MEMBER_DAY} AS source_file_date
  FROM sent
),
split_lines AS (
  SELECT *, str_split(raw_record, '|') AS fields,
         str_split(raw_record, '|')[2] AS record_type,
         CAST(len(str_split(raw_record, '|')) AS INTEGER) AS field_count
  FROM lines
)
"""

DECODED = f"""{LINES},
texts AS (
  SELECT source_path, raw_record, source_file_date, field_count,
    nullif(trim(fields[3]), '') AS name,
    nullif(trim(fields[4]), '') AS mem_id,
    nullif(trim(fields[5]), '') AS enroll_dt_raw,
    nullif(trim(fields[6]), '') AS flight_dt_raw,
    nullif(trim(fields[7]), '') AS tier,
    nullif(trim(fields[8]), '') AS agent_name,
    nullif(trim(fields[9]), '') AS state,
    upper(nullif(trim(fields[10]), '')) AS country_code,
    nullif(trim(fields[11]), '') AS dob_raw,
    upper(nullif(trim(fields[12]), '')) AS flag
  FROM split_lines WHERE record_type = 'D' AND field_count = 12
),
decoded AS (
  SELECT *,
    CAST(try_strptime(enroll_dt_raw, '%Y%m%d') AS DATE) AS enroll_dt,
    CAST(try_strptime(flight_dt_raw, '%Y%m%d') AS DATE) AS flight_dt,
    CAST(coalesce(try_strptime(dob_raw, '%Y%m%d'),
                  try_strptime(dob_raw, '%m%d%Y')) AS DATE) AS dob
  FROM texts
)
"""

AGE = f"""CAST(floor((
  12 * (year({AS_OF}) - year(dob)) + month({AS_OF}) - month(dob)
  - CASE WHEN day({AS_OF}) >= day(dob)
           OR ({AS_OF} = last_day({AS_OF}) AND dob = last_day(dob))
         THEN 0 ELSE 1 END) / 12.0) AS INTEGER)"""
STALE = f"coalesce(date_diff('day', flight_dt, {AS_OF}) > 90, FALSE)"


def _codes(*rules: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in rules)
    return f"concat_ws(',', {cases})"


LINE_CODES = _codes(
    ("INVALID_SOURCE_FILE_DATE", "source_file_date IS NULL"),
    ("INVALID_RECORD_TYPE", "record_type IS NULL OR record_type NOT IN ('H', 'D')"),
    ("INVALID_MEMBER_HEADER", f"record_type = 'H' AND trim(raw_record) <> '{HEADER}'"),
    ("INVALID_MEMBER_FIELD_COUNT", "record_type = 'D' AND field_count <> 12"),
)

MEMBER_CODES = _codes(
    ("INVALID_SOURCE_FILE_DATE", "source_file_date IS NULL"),
    ("INVALID_MEMBER_FIELD_COUNT", "field_count <> 12"),
    ("MISSING_MEMBER_NAME", "name IS NULL"),
    ("MEMBER_NAME_TOO_LONG", "length(name) > 255"),
    ("MISSING_MEMBER_ID", "mem_id IS NULL"),
    (
        "INVALID_MEMBER_ID",
        "length(mem_id) > 18 OR NOT regexp_full_match(mem_id, '[0-9]+')",
    ),
    ("INVALID_ENROLLMENT_DATE", "enroll_dt_raw IS NOT NULL AND enroll_dt IS NULL"),
    ("MISSING_ENROLLMENT_DATE", "enroll_dt IS NULL"),
    ("FUTURE_ENROLLMENT_DATE", f"enroll_dt > {AS_OF}"),
    ("INVALID_LAST_FLIGHT_DATE", "flight_dt_raw IS NOT NULL AND flight_dt IS NULL"),
    ("FUTURE_LAST_FLIGHT_DATE", f"flight_dt > {AS_OF}"),
    ("FLIGHT_BEFORE_ENROLLMENT", "flight_dt < enroll_dt"),
    ("INVALID_DATE_OF_BIRTH", "dob_raw IS NOT NULL AND dob IS NULL"),
    ("FUTURE_DATE_OF_BIRTH", f"dob > {AS_OF}"),
    ("IMPLAUSIBLE_MEMBER_AGE", f"{AGE} < 0 OR {AGE} > 120"),
    ("TIER_CODE_TOO_LONG", "length(tier) > 5"),
    ("AGENT_NAME_TOO_LONG", "length(agent_name) > 255"),
    ("STATE_TOO_LONG", "length(state) > 5"),
    ("MISSING_COUNTRY_CODE", "country_code IS NULL"),
    (
        "UNSUPPORTED_COUNTRY_CODE",
        "country_code NOT IN ('USA', 'IND', 'AUS', 'PHL')",
    ),
    ("INVALID_ACTIVE_MEMBER_FLAG", "flag NOT IN ('A', 'I')"),
)

CHECKED = f"""{DECODED},
checked AS (SELECT *, {MEMBER_CODES} AS codes FROM decoded),
line_checked AS (SELECT *, {LINE_CODES} AS codes FROM split_lines),
staged AS (
  SELECT source_path, source_file_date, name, mem_id, enroll_dt, flight_dt, tier,
         agent_name, state, country_code, dob, flag, {AGE} AS age,
         {STALE} AS stale_member
  FROM checked WHERE codes = ''
)
"""

LATEST_MEMBERS = f"""{CHECKED},
members AS (
  SELECT * FROM staged
  QUALIFY row_number() OVER (
    PARTITION BY mem_id
    ORDER BY source_file_date DESC, source_path DESC, name DESC NULLS LAST,
      enroll_dt DESC NULLS LAST, flight_dt DESC NULLS LAST, tier DESC NULLS LAST,
      agent_name DESC NULLS LAST, state DESC NULLS LAST,
      country_code DESC NULLS LAST, dob DESC NULLS LAST, flag DESC NULLS LAST,
      age DESC NULLS LAST, stale_member DESC NULLS LAST) = 1
)
"""

FEED_PATH = """'incoming/redemption/feed_' || k || '_' || line || '_' || part || '_'
      || supplier || '.json'"""
FEED_CORRUPT = "CASE WHEN k%101=0 THEN '{unreadable' END"
# The same in files of many feeds.
FEED_FILE = "'feed[1] {x}-' || lpad(CAST(k // 4096 AS VARCHAR), 6, '0') || '.json'"

FEEDS = f"""
items AS (
  SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part,
         l_suppkey AS supplier, l_quantity AS quantity, l_linestatus,
         CAST(l_shipdate AS DATE) AS shipped, CAST(o_orderdate AS DATE) AS ordered,
         CAST(o_custkey AS VARCHAR) AS c,
         l_orderkey * 7 + l_linenumber + l_partkey AS h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
feeds AS (
  SELECT *,
    {FEED_PATH} AS source_path,
    CASE WHEN k%71=0 THEN '' WHEN k%73=0 THEN 'A' || c ELSE c END AS member_id,
    CASE WHEN k%79=0 THEN '20241301' WHEN k%83=0 THEN NULL
         WHEN k%89=0 THEN '20990101'
         ELSE strftime(last_day(ordered), '%Y%m%d') END AS feed_date_raw,
    CASE WHEN k%97=0 THEN NULL WHEN h%29=0 THEN 0 WHEN h%113=0 THEN 2
         WHEN h%3=0 THEN 2 ELSE 1 END AS held_transactions,
    {FEED_CORRUPT} AS corrupt
  FROM items
),
dated_feeds AS (
  SELECT *, CAST(try_strptime(feed_date_raw, '%Y%m%d') AS DATE) AS feed_date
  FROM feeds
),
firsts AS (
  SELECT source_path, member_id, feed_date_raw, feed_date, 0 AS feed_position,
    CASE WHEN h%31=0 THEN '' ELSE k || '-' || line END AS txn_id,
    CASE WHEN h%37=0 THEN '20240230' WHEN h%41=0 THEN NULL
         ELSE strftime(shipped, '%Y%m%d') END AS txn_date_raw,
    CASE WHEN h%43=0 THEN '' WHEN h%47=0 THEN repeat('p', 300)
         ELSE 'Partner#' || (supplier % 25) END AS partner,
    CASE WHEN h%53=0 THEN NULL WHEN h%59=0 THEN -1
         ELSE CAST(quantity * 100 AS BIGINT) END AS miles_redeemed,
    CASE WHEN h%61=0 THEN '' WHEN h%67=0 THEN 'REVERSED'
         WHEN l_linestatus = 'F' THEN 'COMPLETED' ELSE 'PENDING' END AS status
  FROM dated_feeds WHERE held_transactions > 0
),
seconds AS (
  SELECT source_path, member_id, feed_date_raw, feed_date, 1 AS feed_position,
    CASE WHEN h%113=0 THEN NULL ELSE k || '-' || line END AS txn_id,
    CASE WHEN h%113=0 THEN NULL ELSE strftime(ordered, '%Y%m%d') END AS txn_date_raw,
    CASE WHEN h%113=0 THEN NULL ELSE 'Settlement' END AS partner,
    CASE WHEN h%113=0 THEN NULL ELSE CAST(quantity * 10 AS BIGINT) END
      AS miles_redeemed,
    CASE WHEN h%113=0 THEN NULL ELSE 'COMPLETED' END AS status
  FROM dated_feeds WHERE held_transactions = 2
),
flat AS (
  SELECT *, CAST(try_strptime(txn_date_raw, '%Y%m%d') AS DATE) AS txn_date
  FROM (SELECT * FROM firsts UNION ALL SELECT * FROM seconds)
)
"""

FEED_CODES = _codes(
    ("INVALID_REDEMPTION_JSON", "corrupt IS NOT NULL"),
    ("MISSING_MEMBER_ID", "member_id IS NULL OR member_id = ''"),
    (
        "INVALID_MEMBER_ID",
        "length(member_id) > 18 OR NOT regexp_full_match(member_id, '[0-9]+')",
    ),
    ("MISSING_FEED_DATE", "feed_date_raw IS NULL OR feed_date_raw = ''"),
    ("INVALID_FEED_DATE", "feed_date_raw <> '' AND feed_date IS NULL"),
    ("FUTURE_FEED_DATE", f"feed_date > {AS_OF}"),
    ("MISSING_REDEMPTIONS_ARRAY", "held_transactions IS NULL"),
)

ROW_CODES = _codes(
    ("INVALID_FEED_DATE", "feed_date_raw <> '' AND feed_date IS NULL"),
    ("MISSING_FEED_DATE", "feed_date IS NULL"),
    ("FUTURE_FEED_DATE", f"feed_date > {AS_OF}"),
    ("MISSING_MEMBER_ID", "member_id IS NULL OR member_id = ''"),
    (
        "INVALID_MEMBER_ID",
        "length(member_id) > 18 OR NOT regexp_full_match(member_id, '[0-9]+')",
    ),
    ("MISSING_TRANSACTION_ID", "txn_id IS NULL OR txn_id = ''"),
    ("INVALID_TRANSACTION_DATE", "txn_date_raw <> '' AND txn_date IS NULL"),
    ("MISSING_TRANSACTION_DATE", "txn_date IS NULL"),
    ("TRANSACTION_AFTER_FEED_DATE", "txn_date > feed_date"),
    ("MISSING_PARTNER", "partner IS NULL OR partner = ''"),
    ("PARTNER_TOO_LONG", "length(partner) > 255"),
    ("MISSING_MILES_REDEEMED", "miles_redeemed IS NULL"),
    ("NEGATIVE_MILES_REDEEMED", "miles_redeemed < 0"),
    ("MISSING_REDEMPTION_STATUS", "status IS NULL OR status = ''"),
    (
        "INVALID_REDEMPTION_STATUS",
        "status <> '' AND status NOT IN ('PENDING', 'COMPLETED')",
    ),
)

CHECKED_FEEDS = f"""{FEEDS},
feeds_checked AS (SELECT *, {FEED_CODES} AS codes FROM dated_feeds),
rows_checked AS (SELECT *, {ROW_CODES} AS codes FROM flat)
"""

LATEST_TRANSACTIONS = f"""{CHECKED_FEEDS},
transactions AS (
  SELECT member_id, txn_id, feed_date, txn_date, partner, miles_redeemed, status,
         source_path
  FROM rows_checked WHERE codes = ''
  QUALIFY row_number() OVER (
    PARTITION BY member_id, txn_id
    ORDER BY CASE status WHEN 'COMPLETED' THEN 2 WHEN 'PENDING' THEN 1 ELSE 0 END
        DESC,
      feed_date DESC, source_path DESC, feed_position DESC, feed_date_raw DESC,
      txn_date_raw DESC, txn_date DESC, partner DESC, miles_redeemed DESC) = 1
)
"""

ITEM_RANK = "CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END"
ITEMS = f"""
items AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_linestatus = 'F' THEN 'COMPLETED' ELSE 'PENDING' END AS status,
         CAST(l_shipdate AS DATE) AS ship_day, CAST(l_quantity AS BIGINT) AS quantity,
         l_returnflag, {ITEM_RANK} AS settled
  FROM lineitem
)
"""


def _latest_items(name: str, where: str) -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (l_returnflag) FROM items WHERE {where}
  QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber
    ORDER BY settled DESC, ship_day DESC, l_partkey DESC, l_suppkey DESC,
      quantity DESC) = 1
)"""


def _latest_orders(name: str, where: str) -> str:
    return f"""{name} AS (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS order_day, o_orderkey,
         o_orderstatus, o_orderpriority
  FROM orders WHERE {where}
  QUALIFY row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
)"""


URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
ITEM_MERGE = f"""{ITEMS}, {_latest_items('held', "l_returnflag = 'R'")},
{_latest_items('sent', "l_returnflag <> 'R'")},
merged AS (
  SELECT
    CASE WHEN held.l_orderkey IS NULL THEN 'inserted'
         WHEN sent.l_orderkey IS NULL THEN 'kept'
         WHEN (sent.settled, sent.ship_day, sent.l_partkey, sent.l_suppkey)
            > (held.settled, held.ship_day, held.l_partkey, held.l_suppkey)
         THEN 'updated' ELSE 'kept' END AS action,
    held, sent
  FROM held FULL JOIN sent
    ON held.l_orderkey = sent.l_orderkey AND held.l_linenumber = sent.l_linenumber
),
chosen AS (
  SELECT action, unnest(CASE WHEN action = 'kept' THEN held ELSE sent END)
  FROM merged
)
"""

PROFILE_FACTS = (
    "t.member_id, t.txn_id, t.feed_date, t.txn_date, t.partner, "
    "t.miles_redeemed, t.status"
)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


MEMBER_FILES = LATEST_MEMBERS.replace(MEMBER_PATH, MEMBER_FILE).replace(
    MEMBER_DAY, FILE_DAY
)
FEED_FILES = LATEST_TRANSACTIONS.replace(FEED_PATH, FEED_FILE).replace(
    FEED_CORRUPT, "CAST(NULL AS VARCHAR)"
)
STREAMED = "SELECT * EXCLUDE (source_path) FROM transactions"

ORACLE: dict[str, str] = {
    "latest_per_key_status": _with(
        f"{ITEMS}, {_latest_items('latest', 'TRUE')}",
        "SELECT * EXCLUDE (settled) FROM latest",
    ),
    "latest_per_key_recency": _with(
        _latest_orders("latest", "TRUE"), "SELECT * FROM latest"
    ),
    "enrich_left_join": _with(
        f"{ITEMS}, {_latest_items('facts', 'TRUE')}, {_latest_orders('latest', 'TRUE')}",
        """SELECT l_orderkey, l_linenumber, ship_day, quantity, status,
             o.o_custkey, c_name, c_mktsegment, order_day, latest.o_orderstatus
           FROM facts
           LEFT JOIN orders o ON l_orderkey = o.o_orderkey
           LEFT JOIN (latest JOIN customer ON latest.o_custkey = c_custkey)
             ON o.o_custkey = c_custkey""",
    ),
    "enrich_profile": _with(
        f"{LATEST_MEMBERS}, {LATEST_TRANSACTIONS}",
        f"""SELECT {PROFILE_FACTS}, m.name, m.enroll_dt, m.flight_dt, m.tier,
              m.agent_name, m.state, m.country_code, m.dob, m.flag, m.age,
              m.stale_member
            FROM transactions t LEFT JOIN members m ON t.member_id = m.mem_id""",
    ),
    "enrich_profile_brief": _with(
        f"{LATEST_MEMBERS}, {LATEST_TRANSACTIONS}",
        f"""SELECT {PROFILE_FACTS}, m.name, m.country_code, m.tier, m.stale_member
            FROM transactions t LEFT JOIN members m ON t.member_id = m.mem_id""",
    ),
    "upsert_recency": _with(
        f"{_latest_orders('held', URGENT)}, {_latest_orders('sent', 'NOT ' + URGENT)}",
        """SELECT unnest(CASE
             WHEN held.o_custkey IS NULL THEN sent
             WHEN sent.o_custkey IS NULL THEN held
             WHEN (sent.order_day, sent.o_orderkey) > (held.order_day, held.o_orderkey)
             THEN sent ELSE held END)
           FROM held FULL JOIN sent ON held.o_custkey = sent.o_custkey""",
    ),
    "upsert_priority": _with(
        ITEM_MERGE, "SELECT * EXCLUDE (action, settled) FROM chosen"
    ),
    "upsert_actions": _with(
        ITEM_MERGE,
        "SELECT action, CAST(count(*) AS BIGINT) AS row_count FROM merged GROUP BY action",
    ),
    "upsert_target": _with(
        ITEM_MERGE, "SELECT * EXCLUDE (action, settled) FROM chosen"
    ),
    "incremental_anti_join": """
        SELECT event_id, user_id, event_type, strftime(ts, '%Y%m%d%H') AS source_path
        FROM events e
        WHERE NOT EXISTS (
          SELECT 1 FROM events seen WHERE seen.event_type = 'error'
            AND date_trunc('hour', seen.ts) = date_trunc('hour', e.ts))""",
    "scan_by_path": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders""",
    "split_fields": _with(
        LINES,
        """SELECT source_path, raw_record, source_file_date, record_type, field_count
           FROM split_lines""",
    ),
    "parse_delimited": _with(DECODED, "SELECT * EXCLUDE (raw_record) FROM decoded"),
    "parse_dates_multi": _with(
        DECODED,
        """SELECT mem_id, dob_raw, dob AS born, enroll_dt_raw, enroll_dt AS enrolled
           FROM decoded""",
    ),
    "flatten_feed": _with(FEEDS, "SELECT * FROM flat"),
    "flatten_json": """
        SELECT event_id, user_id,
               CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
    "rules_structure": _with(
        CHECKED, "SELECT source_path, raw_record, codes FROM line_checked"
    ),
    "rules_member": _with(
        CHECKED, "SELECT source_path, raw_record, codes FROM checked"
    ),
    "rules_feed": _with(
        CHECKED_FEEDS,
        """SELECT source_path, member_id, feed_date_raw, feed_date, codes
           FROM feeds_checked""",
    ),
    "rules_row": _with(
        CHECKED_FEEDS,
        "SELECT source_path, feed_position, txn_id, codes FROM rows_checked",
    ),
    "routed_counts": _with(
        f"{CHECKED}, {CHECKED_FEEDS}",
        """, every_check AS (
             SELECT 'line' AS level, codes FROM line_checked
             UNION ALL SELECT 'member', codes FROM checked
             UNION ALL SELECT 'feed', codes FROM feeds_checked
             UNION ALL SELECT 'transaction', codes FROM rows_checked)
           SELECT level, CASE WHEN codes = '' THEN 'valid' ELSE 'invalid' END AS way,
                  CAST(count(*) AS BIGINT) AS row_count
           FROM every_check GROUP BY ALL""",
    ),
    "quarantine_union": _with(
        CHECKED,
        """SELECT source_path, raw_record, record_type, field_count,
             NULL AS mem_id, NULL AS enroll_dt_raw, CAST(NULL AS DATE) AS enroll_dt,
             CAST(NULL AS DATE) AS dob, codes, TRUE AS is_timed
           FROM line_checked WHERE codes <> ''
           UNION ALL
           SELECT source_path, raw_record, NULL, field_count, mem_id, enroll_dt_raw,
             enroll_dt, dob, codes, TRUE
           FROM checked WHERE codes <> ''""",
    ),
    "quarantine_evolution": _with(
        CHECKED,
        """SELECT source_path, raw_record, NULL AS mem_id, CAST(NULL AS DATE) AS dob,
             CAST(NULL AS INTEGER) AS rule_version, '1' AS batch_id, codes
           FROM line_checked WHERE codes <> ''
           UNION ALL
           SELECT source_path, NULL, mem_id, dob, 2, '2', codes
           FROM checked WHERE codes <> ''""",
    ),
    "quarantine_redemptions": _with(
        CHECKED_FEEDS,
        """SELECT source_path, member_id, feed_date_raw, feed_date, NULL AS txn_id,
             CAST(NULL AS BIGINT) AS miles_redeemed, NULL AS status,
             corrupt AS _corrupt_record, codes, held_transactions
           FROM feeds_checked WHERE codes <> ''
           UNION ALL
           SELECT source_path, member_id, feed_date_raw, feed_date, txn_id,
             miles_redeemed, status, NULL, codes, NULL
           FROM rows_checked WHERE codes <> ''""",
    ),
    "error_summary_members": _with(
        CHECKED,
        """SELECT codes, CAST(count(*) AS BIGINT) AS invalid_row_count FROM (
             SELECT codes FROM line_checked UNION ALL SELECT codes FROM checked)
           WHERE codes <> '' GROUP BY codes""",
    ),
    "error_summary_redemptions": _with(
        CHECKED_FEEDS,
        """SELECT codes, CAST(count(*) AS BIGINT) AS invalid_row_count FROM (
             SELECT codes FROM feeds_checked UNION ALL SELECT codes FROM rows_checked)
           WHERE codes <> '' GROUP BY codes""",
    ),
    "duplicate_keys_1": """
        SELECT o_custkey, CAST(count(*) AS BIGINT) AS duplicate_count
        FROM orders GROUP BY o_custkey HAVING count(*) > 1""",
    "duplicate_keys_2": """
        SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS duplicate_count
        FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "emptiness_counts": """
        SELECT CAST(count(*) AS BIGINT) AS order_count,
          CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS open_count,
          count(*) FILTER (o_orderstatus = 'none') = 0 AS is_empty
        FROM orders""",
    "sorted_limit": """
        SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS order_day
        FROM orders ORDER BY order_day DESC, o_orderkey LIMIT 20""",
    "age_at_ingestion": _with(
        DECODED, f"SELECT mem_id, dob, {AGE} AS age FROM decoded"
    ),
    "stale_flag": _with(
        DECODED, f"SELECT mem_id, flight_dt, {STALE} AS stale_member FROM decoded"
    ),
    "staged_members": _with(CHECKED, "SELECT * FROM staged"),
    "country_fanout": _with(
        LATEST_MEMBERS,
        """SELECT * EXCLUDE (source_path, source_file_date),
             CASE country_code WHEN 'USA' THEN 'usa' WHEN 'IND' THEN 'india'
               WHEN 'AUS' THEN 'australia' ELSE 'philippines' END AS segment
           FROM members""",
    ),
    "export_usa": _with(
        LATEST_MEMBERS,
        """SELECT mem_id AS "ID", name AS "Name", tier AS "TierCode",
             strftime(enroll_dt, '%-m%d%Y') AS "EnrollmentDate"
           FROM members WHERE country_code = 'USA'""",
    ),
    "export_india": _with(
        LATEST_MEMBERS,
        """SELECT mem_id AS "ID", name AS "Name", strftime(dob, '%-m/%d/%Y') AS "DOB",
             tier AS "TierCode", strftime(enroll_dt, '%-m%d%Y') AS "EnrollmentDate",
             CAST(NULL AS VARCHAR) AS "Individual or Corporate",
             strftime(flight_dt, '%-m%d%Y') AS "Flight Date"
           FROM members WHERE country_code = 'IND'""",
    ),
    "export_australia": _with(
        LATEST_MEMBERS,
        """SELECT mem_id AS "Unique ID", name AS "Member Name", tier AS "Tier Type",
             strftime(dob, '%Y-%m-%d') AS "Date of Birth",
             strftime(enroll_dt, '%Y-%m-%d') AS "Date of Enrollment",
             strftime(flight_dt, '%Y-%m-%d') AS "Date of Flight"
           FROM members WHERE country_code = 'AUS'""",
    ),
    "export_dispatch": _with(
        LATEST_MEMBERS,
        """SELECT country, outcome, CAST(count(mem_id) AS BIGINT) AS row_count
           FROM (VALUES ('usa', 'written', 'USA'), ('india', 'written', 'IND'),
                   ('australia', 'written', 'AUS'), ('philippines', 'skipped', ''))
                AS agreed(country, outcome, code)
           LEFT JOIN members ON country_code = code GROUP BY ALL""",
    ),
    "partitioned_roundtrip": """
        SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer""",
    "member_ingest": _with(LATEST_MEMBERS, "SELECT * FROM members"),
    "redemption_ingest": _with(LATEST_TRANSACTIONS, "SELECT * FROM transactions"),
    "ingest_member_files": _with(
        MEMBER_FILES,
        """SELECT 'target' AS part, mem_id AS item,
             concat_ws('|', name, tier, country_code, CAST(enroll_dt AS VARCHAR),
               CAST(flight_dt AS VARCHAR), CAST(age AS VARCHAR), source_path) AS detail,
             CAST(1 AS BIGINT) AS row_count
           FROM members
           UNION ALL SELECT DISTINCT 'ledger', source_path, NULL, 1 FROM lines
           UNION ALL SELECT 'ledger', 'nothing_20020101.txt', NULL, 1 FROM
             (SELECT 1 FROM orders LIMIT 1)
           UNION ALL SELECT 'errors', codes, NULL, count(*) FROM (
             SELECT codes FROM line_checked UNION ALL SELECT codes FROM checked)
           WHERE codes <> '' GROUP BY codes""",
    ),
    "ingest_redemption_files": _with(
        FEED_FILES,
        """, cut AS (SELECT DISTINCT k // 4096 AS number FROM feeds WHERE (k // 4096) % 7 = 3),
           cut_codes AS (SELECT 'INVALID_REDEMPTION_JSON,MISSING_MEMBER_ID,'
             || 'MISSING_FEED_DATE,MISSING_REDEMPTIONS_ARRAY' AS codes FROM cut)
           SELECT 'target' AS part, member_id || '/' || txn_id AS item,
             concat_ws('|', CAST(feed_date AS VARCHAR), CAST(txn_date AS VARCHAR), partner,
               CAST(miles_redeemed AS VARCHAR), status, source_path) AS detail,
             CAST(1 AS BIGINT) AS row_count
           FROM transactions
           UNION ALL SELECT DISTINCT 'ledger', source_path, NULL, 1 FROM feeds
           UNION ALL SELECT 'ledger', 'cut-' || lpad(CAST(number AS VARCHAR), 6, '0')
             || '.json', NULL, 1 FROM cut
           UNION ALL SELECT 'ledger', 'nothing.json', NULL, 1 FROM
             (SELECT 1 FROM orders LIMIT 1)
           UNION ALL SELECT 'errors', codes, NULL, count(*) FROM (
             SELECT codes FROM feeds_checked UNION ALL SELECT codes FROM rows_checked
             UNION ALL SELECT codes FROM cut_codes)
           WHERE codes <> '' GROUP BY codes""",
    ),
    "stream_redemptions_merge": _with(FEED_FILES, STREAMED),
    "profile_view": _with(
        f"{LATEST_MEMBERS}, {LATEST_TRANSACTIONS}",
        f"""SELECT {PROFILE_FACTS}, m.name, m.enroll_dt, m.flight_dt, m.tier,
              m.agent_name, m.state, m.country_code, m.dob, m.flag, m.age,
              m.stale_member
            FROM transactions t LEFT JOIN members m ON t.member_id = m.mem_id""",
    ),
    "country_tables": _with(
        LATEST_MEMBERS,
        """SELECT * EXCLUDE (source_path, source_file_date),
             CASE country_code WHEN 'USA' THEN 'usa' WHEN 'IND' THEN 'india'
               WHEN 'AUS' THEN 'australia' ELSE 'philippines' END AS country_table
           FROM members""",
    ),
    "uniqueness_gate": """
        WITH sizes AS (
          SELECT count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS even FROM customer)
        SELECT 'clean batch' AS attempt, 'accepted' AS outcome, CAST(even AS BIGINT) AS table_rows FROM sizes
        UNION ALL SELECT 'repeated key in batch', 'refused', even FROM sizes
        UNION ALL SELECT 'two NULL keys in batch', 'refused', even FROM sizes
        UNION ALL SELECT 'one NULL key in batch', 'accepted', even + 1 FROM sizes
        UNION ALL SELECT 'key held twice', 'refused', 2 * even + 2 FROM sizes
        UNION ALL SELECT 'other key held twice', 'refused', 2 * even + 2 FROM sizes""",
    "stream_available_now": _with(
        DECODED,
        """SELECT * EXCLUDE (raw_record, source_path, source_file_date)
           FROM decoded""",
    ),
}
