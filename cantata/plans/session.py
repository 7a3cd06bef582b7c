"""Sessions, jobs, clocks and histories, replayed over batches."""

Q = {}

# The first cause sticks
Q["score_eligibility"] = ([], ["events"], """
    SELECT user_id, reason, event_id FROM (
      SELECT user_id, event_type AS reason, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE value > 200) x WHERE r = 1""")
# A position behind an earlier one is a regression
Q["monotone_position"] = ([], ["events"], """
    SELECT user_id, event_id, CASE WHEN value < before THEN 'regressed' ELSE 'moved' END AS status FROM (
      SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) x""")
# The log keeps 64 entries a key; a reader that asks for older ones is told of the gap
Q["event_log_gap"] = ([], ["events"], """
    SELECT user_id, min(seq) AS oldest, max(seq) AS newest, min(seq) > 10 + 1 AS gap FROM (
      SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) x
    WHERE back <= 64 GROUP BY user_id""")
# Replays repeat a command's content; conflicts reuse its id
Q["command_dedup"] = ([], ["orders"], """
    SELECT o_orderkey, CASE WHEN r = 1 THEN 'applied' WHEN content = head THEN 'replay' ELSE 'conflict' END AS outcome FROM (
      SELECT o_orderkey, content, row_number() OVER (PARTITION BY command_id ORDER BY o_orderkey) AS r, first_value(content) OVER (PARTITION BY command_id ORDER BY o_orderkey) AS head FROM (
        SELECT o_orderkey, concat(CAST(o_custkey AS VARCHAR(20)), '/', CAST(o_orderkey % 3 AS VARCHAR(20))) AS command_id, o_orderstatus AS content FROM orders) a) b""")
# An anchor of a past epoch is late: rejected and counted
Q["stale_epochs"] = ([], ["events"], """
    SELECT user_id, sum(CASE WHEN epoch < latest THEN 1 ELSE 0 END) AS stale, count(*) AS seen FROM (
      SELECT user_id, epoch, max(epoch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest FROM (
        SELECT user_id, ts, event_id, event_id % 5 AS epoch FROM events) a) b GROUP BY user_id""")
# Progress never falls; the first terminal state is final
Q["job_latest"] = ([], ["lineitem"], """
    SELECT l_orderkey AS job, max(CASE WHEN ended = 0 OR (ended = 1 AND terminal = 1) THEN progress END) AS progress, max(terminal) = 1 AS finished FROM (
      SELECT l_orderkey, l_quantity AS progress, terminal, sum(terminal) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM (
        SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS terminal FROM lineitem) a) b GROUP BY l_orderkey""")
# Positions keep advancing where samples were refused, so the gap shows
Q["stream_gaps"] = ([], ["events"], """
    SELECT user_id, event_id, step - 1 AS missing FROM (
      SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) x WHERE step > 1""")
Q["backlog_last_two"] = ([], ["events"], """
    SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r <= 2""")
Q["underrun_counter"] = ([], ["events"], """
    SELECT user_id, event_id, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS underruns FROM events""")
Q["preview_stop"] = ([], ["events"], """
    SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE value >= 150) x WHERE r = 1""")
Q["busy_session"] = ([], ["orders"], """
    SELECT o_orderkey, coalesce(open_before, 0) > 0 AS busy FROM (
      SELECT o_orderkey, max(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_before FROM orders) x""")
Q["job_outcome"] = ([], ["orders"], """
    SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'timed_out' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'cancelled' END AS outcome FROM orders""")
