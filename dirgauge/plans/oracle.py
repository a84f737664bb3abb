"""The registered queries in plain SQL, for comparison on another engine.

Each text starts from the raw order tables. `_BASE` derives the inventory; the other parts add the
closure and the statistics where a query needs them.
"""

from __future__ import annotations

_DIRECTORIES = """
fx_region AS (
  SELECT r_regionkey, concat('/', r_name) AS path FROM region),
fx_nation AS (
  SELECT n_nationkey, n_regionkey, concat(r.path, '/', n_name) AS path
  FROM nation JOIN fx_region r ON r_regionkey = n_regionkey),
fx_customer AS (
  SELECT c_custkey, c_nationkey, concat(n.path, '/', c_name) AS path
  FROM customer JOIN fx_nation n ON n_nationkey = c_nationkey),
fx_directories AS (
  SELECT 1000000000 + CAST(r_regionkey AS BIGINT) AS dir_id, path, CAST(NULL AS BIGINT) AS parent_id,
         CAST(1000001 AS BIGINT) AS owner_uid, TIMESTAMP '1995-01-01 00:00:00' AS mtime
  FROM fx_region
  UNION ALL
  SELECT 2000000000 + CAST(n_nationkey AS BIGINT), path, 1000000000 + CAST(n_regionkey AS BIGINT),
         1000002, TIMESTAMP '1995-01-01 00:00:00'
  FROM fx_nation
  UNION ALL
  SELECT 3000000000 + c_custkey, path, 2000000000 + CAST(c_nationkey AS BIGINT),
         1000003, TIMESTAMP '1995-01-01 00:00:00'
  FROM fx_customer
  UNION ALL
  SELECT 4000000000 + o_orderkey, concat(c.path, '/', CAST(o_orderkey AS VARCHAR)), 3000000000 + o_custkey,
         CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE 1000004 END, o_orderdate
  FROM orders JOIN fx_customer c ON c_custkey = o_custkey)"""

_FILES = """
fx_items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq
  FROM lineitem),
fx_files AS (
  SELECT l_orderkey * 1000 + seq AS file_id, 4000000000 + l_orderkey AS dir_id,
         concat('item-', CAST(seq AS VARCHAR)) AS filename,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes, l_suppkey AS owner_uid,
         CASE WHEN l_linenumber <> 7 THEN l_shipdate + INTERVAL '1' DAY * CAST(l_quantity AS INT) END AS atime,
         l_shipdate AS mtime, l_shipdate AS ctime, l_orderkey * 1000 + seq AS inode, 1 AS hardlink_count
  FROM fx_items)"""

_USERS = """
fx_users AS (
  SELECT uid, CASE WHEN uid % 10 = 0 THEN NULL ELSE s_name END AS username, CAST(s_nationkey AS BIGINT) AS gid
  FROM (SELECT owner_uid AS uid FROM fx_files UNION SELECT owner_uid FROM fx_directories) o
  LEFT JOIN supplier ON s_suppkey = uid
  WHERE uid IS NOT NULL)"""

_LISTING = """
fx_listing AS (
  SELECT path, 'd' AS entry_type, CAST(0 AS BIGINT) AS size_bytes, CAST(NULL AS BIGINT) AS inode,
         owner_uid AS uid, CAST(0 AS BIGINT) AS gid, CAST(NULL AS INT) AS nlink,
         CAST(NULL AS TIMESTAMP) AS atime, mtime, CAST(NULL AS TIMESTAMP) AS ctime,
         CAST(NULL AS VARCHAR) AS error_kind
  FROM fx_directories
  UNION ALL
  SELECT concat(d.path, '/', filename), 'f', size_bytes, inode, f.owner_uid, 0, hardlink_count,
         atime, f.mtime, ctime, NULL
  FROM fx_files f JOIN fx_directories d ON d.dir_id = f.dir_id
  UNION ALL
  SELECT concat('/ASIA/link-', CAST(p_partkey AS VARCHAR)), 'l', 0, NULL, 0, 0, NULL,
         NULL, TIMESTAMP '1995-01-01 00:00:00', NULL,
         CASE WHEN p_partkey % 97 = 0 THEN 'NotFound' WHEN p_partkey % 89 = 0 THEN 'IoError' END
  FROM part)"""

# Walks up from every directory; the fixture has a row for every parent.
_CLOSURE = """
fx_closure AS (
  SELECT dir_id AS descendant_id, dir_id AS ancestor_id, 0 AS depth FROM fx_directories
  UNION ALL
  SELECT c.descendant_id, p.parent_id, c.depth + 1
  FROM fx_closure c, fx_directories p
  WHERE p.dir_id = c.ancestor_id AND p.parent_id IS NOT NULL)"""

_STATS = """
fx_below AS (
  SELECT ancestor_id, depth, size_bytes FROM fx_closure JOIN fx_files ON dir_id = descendant_id),
fx_totals AS (
  SELECT ancestor_id,
         CAST(sum(CASE depth WHEN 0 THEN size_bytes END) AS BIGINT) AS direct_bytes,
         CAST(sum(size_bytes) AS BIGINT) AS subtree_bytes,
         count(CASE depth WHEN 0 THEN 1 END) AS file_count,
         count(*) AS subtree_count
  FROM fx_below GROUP BY 1),
fx_stats AS (
  SELECT dir_id, coalesce(direct_bytes, 0) AS direct_bytes, coalesce(subtree_bytes, 0) AS subtree_bytes,
         coalesce(file_count, 0) AS file_count, coalesce(subtree_count, 0) AS subtree_count,
         TIMESTAMP '2001-06-30 00:00:00' AS last_computed
  FROM fx_directories LEFT JOIN fx_totals ON ancestor_id = dir_id),
fx_user_stats AS (
  SELECT f.owner_uid AS uid, r.dir_id, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) AS file_count
  FROM fx_directories r, fx_closure c, fx_files f
  WHERE r.parent_id IS NULL AND c.ancestor_id = r.dir_id AND f.dir_id = c.descendant_id
  GROUP BY 1, 2)"""

# The inventory after a scan of every third customer: rows gone, grown, with another owner, new.
_RESCAN = """
dx_directories AS (
  SELECT dir_id, path, parent_id FROM fx_directories
  WHERE NOT (dir_id >= 4000000000 AND (parent_id - 3000000000) % 3 = 0 AND (dir_id - 4000000000) % 5 = 0)
  UNION ALL
  SELECT dir_id + 2000000000, concat(path, '/new'), dir_id FROM fx_directories
  WHERE dir_id >= 3000000000 AND dir_id < 4000000000 AND (dir_id - 3000000000) % 3 = 0),
dx_files AS (
  SELECT f.dir_id,
         CASE WHEN scanned AND file_id % 1000 % 4 = 1 THEN size_bytes * 2 + 1 ELSE size_bytes END AS size_bytes,
         CASE WHEN scanned AND file_id % 1000 % 4 = 1 THEN 999 ELSE owner_uid END AS owner_uid
  FROM fx_files f
  JOIN (SELECT dir_id, (parent_id - 3000000000) % 3 = 0 AS scanned FROM dx_directories) d ON d.dir_id = f.dir_id
  WHERE NOT (scanned AND file_id % 1000 % 4 = 0)
  UNION ALL
  SELECT dir_id, dir_id - 5000000000, 1000003 FROM dx_directories WHERE dir_id >= 5000000000),
dx_closure AS (
  SELECT dir_id AS descendant_id, dir_id AS ancestor_id, 0 AS depth FROM dx_directories
  UNION ALL
  SELECT c.descendant_id, p.parent_id, c.depth + 1
  FROM dx_closure c, dx_directories p
  WHERE p.dir_id = c.ancestor_id AND p.parent_id IS NOT NULL)"""

_RUNS = """
fx_runs AS (
  SELECT min(o_orderkey) AS id, o_orderdate AS finished_at FROM orders GROUP BY o_orderdate)"""

_BASE = _DIRECTORIES + "," + _FILES
_DERIVED = _BASE + "," + _USERS + "," + _CLOSURE + "," + _STATS


def _sql(parts: str, query: str) -> str:
    return f"WITH RECURSIVE {parts.strip()}\n{query.strip()}"


def _tenths(unit: str, even: bool) -> str:
    """size / unit with one decimal in whole-number arithmetic."""
    tie = "AND (size * 10 // UNIT) % 2 = 1" if even else ""
    text = f"""(SELECT concat(CAST(n // 10 AS VARCHAR), '.', CAST(n % 10 AS VARCHAR)) FROM (SELECT
      size * 10 // UNIT + CASE WHEN 2 * (size * 10 % UNIT) > UNIT
        OR (2 * (size * 10 % UNIT) = UNIT {tie}) THEN 1 ELSE 0 END AS n))"""
    return text.replace("UNIT", unit)


def _fmt(even: bool, units: list[tuple[str, str]], rest: str) -> str:
    cases = " ".join(
        f"WHEN size >= {size} THEN concat({_tenths(size, even)}, ' {name}')" for name, size in units
    )
    return f"CASE {cases} ELSE {rest} END"


_STORED = """SELECT d.path, filename, size_bytes, f.owner_uid FROM fx_files f
JOIN fx_directories d ON d.dir_id = f.dir_id"""
_KB, _MB, _GB, _TB = "1024", "1048576", "1073741824", "1099511627776"
_FMT_BYTES = _fmt(True, [("GB", _GB), ("MB", _MB), ("KB", _KB)], "concat(CAST(size AS VARCHAR), ' B')")
_FMT_BYTES_TB = _fmt(
    False, [("TB", _TB), ("GB", _GB), ("MB", _MB)], f"concat({_tenths(_KB, False)}, ' KB')"
)
_LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')"
_STALE = """
SELECT concat(CAST(extract(year FROM q) AS VARCHAR), ' Q', CAST(extract(quarter FROM q) AS VARCHAR)) AS label,
       count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
FROM (SELECT date_trunc('quarter', atime) AS q, size_bytes FROM fx_files
      WHERE atime > TIMESTAMP '2000-01-01 00:00:00' AND atime <= TIMESTAMP '2001-07-01 00:00:00' AND {who})
GROUP BY q"""

_ACCOUNTS = """
fx_accounts AS (
  SELECT s_suppkey AS uid, upper(s_name) AS username, CAST(s_nationkey + 100 AS BIGINT) AS gid FROM supplier
  UNION ALL SELECT c_custkey + 2000000, c_name, CAST(c_nationkey AS BIGINT) FROM customer)"""


def _report_text(order: str, label: str, unit: int) -> str:
    """Titles, rule, files in `order`, rule, totals; sizes in `unit` with two decimals, ties to even."""
    title = f"{'Path':<60} {f'Size ({label})':>12} {'UID':>6}"
    return _sql(
        _BASE + "," + _LISTING,
        f"""SELECT n + 2 AS position, line FROM (
              SELECT row_number() OVER (ORDER BY {order}) AS n,
                     concat(rpad(path, CAST(greatest(length(path), 60) AS INT), ' '), ' ',
                       lpad(concat(CAST(c // 100 AS VARCHAR), '.', lpad(CAST(c % 100 AS VARCHAR), 2, '0')), 12, ' '),
                       ' ', lpad(CAST(owner_uid AS VARCHAR), greatest(6, length(CAST(owner_uid AS VARCHAR)))::INT, ' '))
                       AS line
              FROM (SELECT path, size_bytes, uid AS owner_uid,
                      size_bytes * 100 // {unit} + CASE WHEN size_bytes * 100 % {unit} * 2 > {unit}
                        OR (size_bytes * 100 % {unit} * 2 = {unit} AND (size_bytes * 100 // {unit}) % 2 = 1)
                        THEN 1 ELSE 0 END AS c
                    FROM fx_listing WHERE entry_type = 'f' AND error_kind IS NULL))
            UNION ALL
            SELECT CASE WHEN k > 2 THEN files + k ELSE k END, CASE k WHEN 1 THEN '{title}'
                     WHEN 4 THEN concat('files:  ', CAST(files AS VARCHAR))
                     WHEN 5 THEN concat('bytes:  ', CAST(bytes AS VARCHAR))
                     WHEN 6 THEN concat('errors: ', CAST(errors AS VARCHAR))
                     ELSE repeat('-', 80) END
            FROM (SELECT count(CASE WHEN entry_type = 'f' AND error_kind IS NULL THEN 1 END) AS files,
                         coalesce(sum(CASE WHEN entry_type = 'f' AND error_kind IS NULL THEN size_bytes END), 0) AS bytes,
                         count(error_kind) AS errors FROM fx_listing)
            CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6])::BIGINT AS k)""",
    )


def oracle_sql() -> dict[str, str]:
    return {
        # Sources and ingest
        "inventory_load": _sql(_BASE + "," + _LISTING, "SELECT * FROM fx_listing"),
        "entry_classify": _sql(
            _BASE + "," + _LISTING,
            """SELECT path, CASE entry_type WHEN 'd' THEN 'directory' ELSE 'file' END AS kind
               FROM fx_listing WHERE error_kind IS NULL AND entry_type IN ('d', 'f')""",
        ),
        "tree_resolve": _sql(
            _BASE,
            """SELECT 'directory' AS kind, d.path, p.path AS parent_path
               FROM fx_directories d LEFT JOIN fx_directories p ON p.dir_id = d.parent_id
               UNION ALL
               SELECT 'file', concat(d.path, '/', filename), d.path FROM fx_files f
               JOIN fx_directories d ON d.dir_id = f.dir_id""",
        ),
        "id_seed": _sql(
            _BASE,
            """SELECT m AS max_seen, m + 1 AS min_id, m + n AS max_id, n AS ids, n AS distinct_ids
               FROM (SELECT max(dir_id) AS m, count(*) AS n FROM fx_directories)""",
        ),
        "error_split": _sql(
            _BASE + "," + _LISTING,
            "SELECT path, error_kind FROM fx_listing WHERE error_kind IS NOT NULL",
        ),
        "error_counts": _sql(
            _BASE + "," + _LISTING,
            """SELECT error_kind, count(*) AS n FROM fx_listing
               WHERE error_kind IS NOT NULL GROUP BY error_kind""",
        ),
        "multi_root": _sql(
            _BASE + "," + _LISTING,
            """SELECT split_part(path, '/', 2) AS filesystem, path, entry_type, size_bytes FROM fx_listing""",
        ),
        "delta_filter": _sql(
            _BASE + "," + _LISTING,
            """SELECT path, entry_type, mtime FROM fx_listing
               WHERE mtime IS NULL OR mtime >= TIMESTAMP '2000-01-01 00:00:00'""",
        ),
        "delta_by_directory": _sql(
            _BASE,
            """SELECT concat(d.path, '/', filename) AS path, f.mtime FROM fx_files f
               JOIN fx_directories d ON d.dir_id = f.dir_id WHERE f.mtime >= d.mtime
               UNION ALL
               SELECT d.path, d.mtime FROM fx_directories d
               LEFT JOIN fx_directories p ON p.dir_id = d.parent_id
               WHERE p.dir_id IS NULL OR d.mtime >= p.mtime
               UNION ALL
               SELECT concat('/ASIA/link-', CAST(p_partkey AS VARCHAR)), TIMESTAMP '1995-01-01 00:00:00'
               FROM part""",
        ),
        "device_pack": """
            SELECT l_suppkey AS major, l_partkey AS minor, count(*) AS n,
                   l_suppkey * 4294967296 + l_partkey AS device
            FROM lineitem GROUP BY l_suppkey, l_partkey""",
        "epoch_ts": """
            SELECT sec, nsec, CASE WHEN sec BETWEEN -8334601228800 AND 8210266876799
                THEN sec * 1000000 + nsec // 1000 ELSE 0 END AS micros
            FROM (SELECT CASE WHEN l_linenumber = 1 THEN l_orderkey * 10000000000
                              WHEN l_linenumber = 2 THEN -l_orderkey * 1000000000
                              ELSE epoch(l_shipdate)::BIGINT - l_orderkey END AS sec,
                         (l_partkey * 7919 + l_suppkey * 104729) % 1000000000 AS nsec FROM lineitem)""",
        "account_source": _sql(_ACCOUNTS, "SELECT * FROM fx_accounts"),
        "table_counts": _sql(
            _DERIVED,
            """SELECT 'files' AS "table", count(*) AS n FROM fx_files
               UNION ALL SELECT 'directories', count(*) FROM fx_directories
               UNION ALL SELECT 'directory_stats', count(*) FROM fx_stats
               UNION ALL SELECT 'directory_closure', count(*) FROM fx_closure
               UNION ALL SELECT 'users', count(*) FROM fx_users""",
        ),
        # Sinks and maintenance
        "append_inventory": _sql(
            _BASE,
            """SELECT d.path, filename, size_bytes, f.owner_uid, atime, f.mtime, ctime, inode, hardlink_count,
                      TIMESTAMP '2001-06-30 00:00:00' AS last_seen
               FROM fx_files f JOIN fx_directories d ON d.dir_id = f.dir_id""",
        ),
        "ingest_retry": _sql(_BASE, _STORED),
        "ingest_balance": _sql(
            _BASE + "," + _LISTING,
            """SELECT * FROM (
                 SELECT 'directories' AS outcome, count(*) AS n FROM fx_directories
                 UNION ALL SELECT 'files', count(*) FROM fx_files
                 UNION ALL SELECT 'skipped', count(*) + (SELECT count(*) FROM region) FROM fx_listing
                           WHERE entry_type = 'l' AND error_kind IS NULL
                 UNION ALL SELECT error_kind, count(*) FROM fx_listing WHERE error_kind IS NOT NULL GROUP BY 1
                 UNION ALL SELECT 'Repeated', count(*) + (SELECT count(*) FROM region) FROM fx_files WHERE inode % 50 = 0
                 UNION ALL SELECT 'BadType', count(*) FROM part WHERE p_partkey % 10 = 0
                 UNION ALL SELECT 'NoPath', count(*) FROM supplier
                 UNION ALL SELECT 'NoSize', count(*) FROM customer
                 UNION ALL SELECT 'NoParent', count(*) FROM nation
                 UNION ALL
                 SELECT 'failed', (SELECT count(*) FROM fx_files WHERE inode % 50 = 0) + (SELECT count(*) FROM region)
                   + (SELECT count(*) FROM part WHERE p_partkey % 10 = 0) + (SELECT count(*) FROM supplier)
                   + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)
                   + (SELECT count(error_kind) FROM fx_listing)
                 UNION ALL
                 SELECT 'listed', (SELECT count(*) FROM fx_listing) + (SELECT count(*) FROM fx_files WHERE inode % 50 = 0)
                   + (SELECT 2 * count(*) FROM region) + (SELECT count(*) FROM part WHERE p_partkey % 10 = 0)
                   + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)
               ) WHERE n > 0""",
        ),
        "late_file_of_filesystem": _sql(
            _BASE,
            """SELECT filesystem, path, count(size) AS files, CAST(sum(size) AS BIGINT) AS bytes
               FROM (SELECT filesystem, path, CASE WHEN dir_id >= 2000000000 AND (filesystem = 'one' OR dir_id % 2 = 0)
                                                   THEN dir_id - 2000000000 END AS size
                     FROM fx_directories, (SELECT unnest(['one', 'two']) AS filesystem) WHERE dir_id < 3000000000)
               GROUP BY ALL""",
        ),
        "delta_apply": _sql(
            _BASE + "," + _RESCAN,
            """SELECT path, CAST(coalesce(sum(CASE depth WHEN 0 THEN size_bytes END), 0) AS BIGINT) AS direct_bytes,
                      CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS subtree_bytes,
                      count(CASE WHEN depth = 0 AND size_bytes IS NOT NULL THEN 1 END) AS file_count,
                      count(size_bytes) AS subtree_count
               FROM dx_directories d JOIN dx_closure c ON c.ancestor_id = d.dir_id
               LEFT JOIN dx_files f ON f.dir_id = c.descendant_id GROUP BY d.dir_id, path""",
        ),
        "delta_users": _sql(
            _BASE + "," + _RESCAN,
            """SELECT owner_uid AS uid, path, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) AS file_count
               FROM dx_directories r JOIN dx_closure c ON c.ancestor_id = r.dir_id
               JOIN dx_files f ON f.dir_id = c.descendant_id
               WHERE r.parent_id IS NULL GROUP BY 1, 2""",
        ),
        "report_table": _sql(
            _BASE,
            """SELECT path, size_bytes / 1024.0::DOUBLE AS size, owner_uid AS uid,
                 concat(rpad(path, CAST(greatest(length(path), 60) AS INT), ' '), ' ',
                   lpad(concat(CAST(n // 100 AS VARCHAR), '.', lpad(CAST(n % 100 AS VARCHAR), 2, '0')), 12, ' '),
                   ' ', lpad(CAST(owner_uid AS VARCHAR), 6, ' ')) AS line
               FROM (SELECT concat(d.path, '/', filename) AS path, size_bytes, f.owner_uid,
                       size_bytes * 100 // 1024 + CASE WHEN size_bytes * 100 % 1024 > 512
                         OR (size_bytes * 100 % 1024 = 512 AND (size_bytes * 100 // 1024) % 2 = 1)
                         THEN 1 ELSE 0 END AS n
                     FROM fx_files f JOIN fx_directories d ON d.dir_id = f.dir_id)""",
        ),
        "report_text": _report_text("string_split(path, '/')", "KB", 1024),
        "report_text_by_size": _report_text("size_bytes DESC, string_split(path, '/')", "MB", 1024 * 1024),
        "report_text_by_owner": _report_text("owner_uid, string_split(path, '/')", "B", 1),
        "file_lines": _sql(
            _BASE,
            """SELECT concat('[FILE] "', d.path, '/', filename, '" size=', CAST(size_bytes AS VARCHAR),
                             ' uid=', CAST(f.owner_uid AS VARCHAR)) AS line
               FROM fx_files f JOIN fx_directories d ON d.dir_id = f.dir_id""",
        ),
        "scan_totals": _sql(
            _BASE + "," + _LISTING,
            """SELECT count(CASE WHEN entry_type = 'f' AND error_kind IS NULL THEN 1 END) AS files,
                      CAST(sum(CASE WHEN entry_type = 'f' AND error_kind IS NULL THEN size_bytes END) AS BIGINT)
                        AS bytes,
                      count(error_kind) AS errors
               FROM fx_listing""",
        ),
        "create_clear": _sql(
            _BASE + "," + _USERS + "," + _RUNS,
            """SELECT 'files' AS "table", count(*) AS before, 0::BIGINT AS after FROM fx_files
               UNION ALL SELECT 'directories', count(*), 0 FROM fx_directories
               UNION ALL SELECT 'users', count(*), 0 FROM fx_users
               UNION ALL SELECT 'crawl_runs', count(*), 0 FROM fx_runs""",
        ),
        "run_log": _sql(
            _RUNS,
            """SELECT id, finished_at FROM fx_runs
               UNION ALL SELECT max(id) + 1, TIMESTAMP '2001-06-30 00:00:00' FROM fx_runs""",
        ),
        "insert_absent": _sql(
            _BASE,
            """SELECT uid, max(username) AS username, max(gid) AS gid FROM (
                 SELECT s_suppkey AS uid, s_name AS username, CAST(s_nationkey AS BIGINT) AS gid FROM supplier
                 UNION ALL SELECT owner_uid, NULL, NULL FROM fx_files
                 UNION ALL SELECT owner_uid, NULL, NULL FROM fx_directories)
               WHERE uid IS NOT NULL GROUP BY uid""",
        ),
        "upsert": _sql(
            _DERIVED,
            """SELECT uid, dir_id, total_bytes, file_count FROM fx_user_stats
               UNION ALL
               SELECT p.uid, 1000000000 + CAST(n_regionkey AS BIGINT), 0, 0
               FROM (SELECT s_suppkey AS uid, s_nationkey AS nation FROM supplier
                     UNION ALL SELECT c_custkey + 2000000, c_nationkey FROM customer) p
               JOIN nation ON n_nationkey = nation
               LEFT JOIN fx_user_stats u ON u.uid = p.uid AND u.dir_id = 1000000000 + n_regionkey
               WHERE u.uid IS NULL""",
        ),
        "enrich_users": _sql(
            _BASE + "," + _USERS + "," + _ACCOUNTS,
            """SELECT u.uid, CASE WHEN a.uid IS NULL THEN u.username ELSE a.username END AS username,
                      CASE WHEN a.uid IS NULL THEN u.gid ELSE a.gid END AS gid
               FROM fx_users u LEFT JOIN fx_accounts a ON a.uid = u.uid""",
        ),
        # Builds
        "users_build": _sql(
            _BASE,
            """SELECT DISTINCT owner_uid AS uid FROM (
                 SELECT owner_uid FROM fx_files UNION ALL SELECT owner_uid FROM fx_directories)
               WHERE owner_uid IS NOT NULL""",
        ),
        "closure_build": _sql(
            _DIRECTORIES + "," + _CLOSURE, "SELECT ancestor_id, descendant_id, depth FROM fx_closure"
        ),
        "direct_stats": _sql(
            _FILES,
            """SELECT dir_id, CAST(sum(size_bytes) AS BIGINT) AS direct_bytes, count(*) AS file_count
               FROM fx_files GROUP BY dir_id""",
        ),
        "subtree_stats": _sql(
            _DERIVED, "SELECT ancestor_id AS dir_id, subtree_bytes, subtree_count FROM fx_totals"
        ),
        "directory_stats": _sql(_DERIVED, "SELECT * FROM fx_stats"),
        "user_stats": _sql(_DERIVED, "SELECT * FROM fx_user_stats"),
        "integrity_audit": _sql(
            _BASE,
            """SELECT 'pk:files' AS rule, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS "key", count(*) AS n
               FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber HAVING count(*) > 1
               UNION ALL
               SELECT 'fk:directories.owner_uid->users', CAST(owner_uid AS VARCHAR), count(*)
               FROM fx_directories
               WHERE owner_uid IS NOT NULL AND owner_uid NOT IN (SELECT owner_uid FROM fx_files)
               GROUP BY owner_uid""",
        ),
        "full_build": _sql(
            _DERIVED,
            """SELECT 'directory_closure' AS "table", count(*) AS n, CAST(sum(depth) AS BIGINT) AS total FROM fx_closure
               UNION ALL
               SELECT 'directory_stats', count(*), CAST(sum(direct_bytes + subtree_bytes) AS BIGINT) FROM fx_stats
               UNION ALL
               SELECT 'user_stats', count(*), CAST(sum(total_bytes) AS BIGINT) FROM fx_user_stats
               UNION ALL
               SELECT 'users', count(*), CAST(sum(uid) AS BIGINT) FROM fx_users
               UNION ALL
               SELECT 'crawl_runs', 1, 1""",
        ),
        # Reports
        "filesystems": _sql(
            _DERIVED,
            """SELECT r.dir_id, r.path, s.subtree_bytes, s.subtree_count
               FROM fx_directories r JOIN fx_stats s ON s.dir_id = r.dir_id WHERE r.parent_id IS NULL""",
        ),
        "users": _sql(
            _BASE + "," + _USERS,
            """SELECT uid, coalesce(username, CAST(uid AS VARCHAR)) AS display_name,
                      coalesce(b, 0) AS total_bytes, coalesce(n, 0) AS file_count
               FROM fx_users LEFT JOIN (
                 SELECT owner_uid, CAST(sum(size_bytes) AS BIGINT) AS b, count(*) AS n FROM fx_files GROUP BY 1)
                 ON owner_uid = uid""",
        ),
        "user_breakdown": _sql(
            _DERIVED,
            """SELECT d.dir_id, d.path AS filesystem, s.total_bytes AS bytes, s.file_count
               FROM fx_user_stats s JOIN fx_directories d USING (dir_id) WHERE uid = 7""",
        ),
        "dir_children": _sql(
            _DERIVED,
            """SELECT c.dir_id, c.path, s.subtree_bytes, s.subtree_count
               FROM fx_directories c JOIN fx_stats s ON s.dir_id = c.dir_id
               WHERE c.parent_id = 1000000002""",
        ),
        "user_dir_children": _sql(
            _BASE + "," + _CLOSURE,
            """SELECT c.dir_id, c.path, CAST(sum(size_bytes) AS BIGINT) AS user_bytes, count(*) AS user_files,
                      max(f.mtime) AS last_mtime
               FROM fx_files f, fx_closure t, fx_directories c
               WHERE f.owner_uid = 7 AND t.descendant_id = f.dir_id AND c.dir_id = t.ancestor_id
                 AND c.parent_id = 1000000002
               GROUP BY c.dir_id, c.path""",
        ),
        "user_dir_labels": _sql(
            _BASE + "," + _CLOSURE,
            f"""SELECT dir_id, split_part(path, '/', -1) AS name, {_FMT_BYTES} AS size,
                       coalesce(strftime({_LOCAL}, '%Y-%m-%d %H:%M'), '—') AS modified, user_files
                FROM (
                  SELECT c.dir_id, c.path, CAST(sum(size_bytes) AS BIGINT) AS size, count(*) AS user_files,
                         max(f.mtime) AS ts
                  FROM fx_files f, fx_closure t, fx_directories c
                  WHERE f.owner_uid = 7 AND t.descendant_id = f.dir_id AND c.dir_id = t.ancestor_id
                    AND c.parent_id = 1000000002
                  GROUP BY c.dir_id, c.path)""",
        ),
        "user_tree": _sql(
            _BASE,
            """SELECT f.dir_id, any_value(path) AS path, CAST(sum(size_bytes) AS BIGINT) AS user_bytes,
                      count(*) AS user_files, max(f.mtime) AS last_mtime
               FROM fx_files f JOIN fx_directories d ON d.dir_id = f.dir_id
               WHERE f.owner_uid = 7 GROUP BY f.dir_id
               ORDER BY last_mtime DESC NULLS LAST, f.dir_id LIMIT 200""",
        ),
        "last_crawled": _sql(
            _RUNS,
            f"""SELECT ts AS finished_at, concat('data as of ', strftime({_LOCAL}, '%Y-%m-%d')) AS label
                FROM (SELECT max(finished_at) AS ts FROM fx_runs)""",
        ),
        "staleness": _sql(_FILES, _STALE.format(who="true")),
        "staleness_chart": _sql(
            _FILES + ", fx_stale AS (" + _STALE.format(who="true") + ")",
            f"""SELECT label, CAST({_tenths(_GB, False)} AS DOUBLE) AS gigabytes,
                       concat(CASE WHEN n >= 1000 THEN concat(CAST(n // 1000 AS VARCHAR), ',',
                         lpad(CAST(n % 1000 AS VARCHAR), 3, '0')) ELSE CAST(n AS VARCHAR) END, ' files') AS files
                FROM (SELECT label, total_bytes AS size, file_count AS n FROM fx_stale)""",
        ),
        "user_staleness": _sql(_FILES, _STALE.format(who="owner_uid = 7")),
        "user_summary": _sql(
            _BASE + "," + _USERS,
            """SELECT max(coalesce(username, CAST(uid AS VARCHAR))) AS display_name,
                      CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes, count(file_id) AS file_count
               FROM fx_users LEFT JOIN fx_files ON owner_uid = uid WHERE uid = 7""",
        ),
        "cumulative_size": _sql(
            _DERIVED, "SELECT subtree_bytes AS total_bytes FROM fx_totals WHERE ancestor_id = 1000000002"
        ),
        "descendants": _sql(
            _DIRECTORIES + "," + _CLOSURE,
            "SELECT descendant_id AS dir_id, depth FROM fx_closure WHERE ancestor_id = 1000000002",
        ),
        "usage_by_username": _sql(
            _BASE + "," + _USERS,
            """SELECT username, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
               FROM fx_users JOIN fx_files ON owner_uid = uid GROUP BY username""",
        ),
        "top_dirs": _sql(
            _DERIVED,
            """SELECT path, subtree_bytes, subtree_count
               FROM fx_stats JOIN fx_directories USING (dir_id)
               ORDER BY subtree_bytes DESC, path LIMIT 20""",
        ),
        "grand_totals": _sql(
            _FILES,
            """SELECT CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) AS total_files FROM fx_files""",
        ),
        "size_share": _sql(
            _BASE + "," + _USERS,
            """SELECT uid, b AS total_bytes, CAST((b * 2000 + m) // (2 * m) AS BIGINT) / 10.0::DOUBLE AS pct
               FROM (SELECT uid, b, max(b) OVER () AS m FROM (
                 SELECT uid, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS b
                 FROM fx_users LEFT JOIN fx_files ON owner_uid = uid GROUP BY uid))""",
        ),
        "sorted_listing": _sql(
            _DERIVED,
            """SELECT path, subtree_bytes, subtree_count FROM fx_stats JOIN fx_directories USING (dir_id)""",
        ),
        "sorted_listing_places": _sql(
            _DERIVED + ", fx_listed AS (SELECT * FROM fx_stats JOIN fx_directories USING (dir_id))",
            """SELECT 'path' AS "by", row_number() OVER (ORDER BY lower(path), path) AS place, path FROM fx_listed
               UNION ALL SELECT 'subtree_bytes', row_number() OVER (ORDER BY subtree_bytes DESC, path), path
               FROM fx_listed
               UNION ALL SELECT 'subtree_count', row_number() OVER (ORDER BY subtree_count, path), path
               FROM fx_listed
               UNION ALL SELECT 'mtime', row_number() OVER (ORDER BY mtime DESC NULLS LAST, path), path
               FROM fx_listed""",
        ),
        "breadcrumb": _sql(
            _DIRECTORIES + "," + _CLOSURE,
            """SELECT d.dir_id, split_part(d.path, '/', -1) AS name, CAST(h - c.depth AS INT) AS level
               FROM (SELECT *, max(depth) OVER () AS h FROM fx_closure WHERE descendant_id = 2000000002) c
               JOIN fx_directories d ON d.dir_id = c.ancestor_id""",
        ),
        # Scalar functions, over every directory or file
        "fmt_bytes": _sql(
            _DERIVED,
            f"SELECT dir_id, size, {_FMT_BYTES} AS label FROM (SELECT dir_id, subtree_bytes AS size FROM fx_stats)",
        ),
        "fmt_bytes_tb": _sql(
            _DERIVED,
            f"""SELECT dir_id, size, {_FMT_BYTES_TB} AS label
                FROM (SELECT dir_id, subtree_bytes * 64 AS size FROM fx_stats)""",
        ),
        "fmt_mtime": _sql(
            _FILES,
            f"""SELECT file_id, coalesce(strftime({_LOCAL}, '%Y-%m-%d %H:%M'), '—') AS label
                FROM (SELECT file_id, atime + INTERVAL '1' MINUTE * CAST(file_id % 1440 AS INT) AS ts FROM fx_files)""",
        ),
        "base_name": _sql(
            _DIRECTORIES,
            """SELECT path, split_part(path, '/', -1) AS segment, split_part(path, '/', -1) AS name,
                      '' AS slash_segment, split_part(path, '/', -1) AS slash_name
               FROM fx_directories""",
        ),
        # Streaming
        "stream_ingest": _sql(_BASE, _STORED),
        "stream_late": _sql(_BASE, _STORED),
        "stream_totals": _sql(
            _BASE + "," + _LISTING,
            """SELECT count(CASE WHEN entry_type = 'f' AND error_kind IS NULL THEN 1 END) AS files,
                      CAST(sum(CASE WHEN entry_type = 'f' AND error_kind IS NULL THEN size_bytes END) AS BIGINT)
                        AS bytes,
                      count(error_kind) AS errors
               FROM fx_listing""",
        ),
    }
