"""The domain's tables, projected from the driver tables; one SQL text per view."""

VIEWS = {
    # Hop 480 samples at 48 kHz; below 55 Hz a frame is unvoiced.
    "pitch_frame": """
        SELECT user_id AS song_id, event_id, event_type, value,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
               CASE WHEN value >= 55 THEN value END AS f0_hz,
               CASE WHEN value >= 55 THEN 69 + 12 * log2(value / 440) END AS midi,
               (event_id % 100) / 100.0E0 AS confidence,
               CASE WHEN value >= 110 THEN 1.0E0 ELSE value / 110.0E0 END AS voiced_probability
        FROM events WHERE user_id IS NOT NULL""",
    "boundary": """
        SELECT song_id, idx * 480 AS sample, (event_id % 97) / 96.0E0 AS probability FROM pitch_frame WHERE event_type = 'click'""",
    # Onsets lie on a grid of 9,600 samples, so that notes overlap and some begin together.
    "note": """
        SELECT song_id, seq, CAST(floor(before / 9600) AS BIGINT) * 9600 AS start_sample, CAST(floor(before / 9600) AS BIGINT) * 9600 + held AS end_sample, midi_note, confidence FROM (
          SELECT l_orderkey AS song_id, row_number() OVER w AS seq, CAST(l_quantity * 480 AS BIGINT) AS held,
                 coalesce(sum(CAST(l_quantity * 320 AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 CAST(36 + l_partkey % 60 AS BIGINT) AS midi_note, round(1 - l_discount, 4) AS confidence
          FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) n""",
    "lyric_segment": """
        SELECT conv_id AS song_id, turn, role, 4800 * turn AS start_sample,
               4800 * turn + length(coalesce(text, '')) * 240 AS end_sample
        FROM conversations""",
}
SOURCES = {"pitch_frame": ["events"], "boundary": ["events"], "note": ["lineitem"], "lyric_segment": ["conversations"]}
NEEDS = {"boundary": ["pitch_frame"]}


# The same views for Spark's plans: keys get their names below the windows, so that what follows per song finds the rows already dealt by song and moves none.
DEALT = VIEWS | {
    "pitch_frame": VIEWS["pitch_frame"].replace("SELECT user_id AS song_id,", "SELECT song_id,").replace("PARTITION BY user_id", "PARTITION BY song_id").replace("FROM events WHERE user_id IS NOT NULL", "FROM (SELECT user_id AS song_id, event_id, event_type, value, ts FROM events WHERE user_id IS NOT NULL) e"),
    "note": VIEWS["note"].replace("l_orderkey AS song_id", "song_id").replace("PARTITION BY l_orderkey", "PARTITION BY song_id").replace("FROM lineitem WINDOW", "FROM (SELECT l_orderkey AS song_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount FROM lineitem) l WINDOW"),
}


def closure(names):
    """Views in order of need."""
    out = []
    for n in names:
        for m in closure(NEEDS.get(n, [])) + [n]:
            if m not in out:
                out.append(m)
    return out


def with_views(names, body, texts=VIEWS):
    """A self-contained query: the views as common table expressions, then the body."""
    views = closure(names)
    if not views:
        return body
    parts = [f"{n} AS ({texts[n].strip()})" for n in views]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
