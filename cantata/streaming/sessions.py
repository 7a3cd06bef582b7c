"""Playing sessions, job progress and followers as keyed state over streams or tables."""
from pyspark.sql import DataFrame

from . import state

#: What a session remembers.
COMMANDS, CREDITS = 128, 256
TERMINAL = {"finished", "stopped", "failed"}
#: Plays and pauses: state and command -> state after; the same state is no change.
MOVES = {("ready", "play"): "playing", ("paused", "play"): "playing", ("playing", "play"): "playing", ("playing", "pause"): "paused", ("ready", "pause"): "ready", ("paused", "pause"): "paused"}
COMMAND_KINDS = {"play", "pause", "seek", "stop"}
SCHEMA = "seq long, kind string, disposition string, error string, state string, revision long, epoch long, position long, eligibility string, stale_rejections long, fresh_samples long"


class Rejected(Exception):
    pass


def _go(s, to):
    s["state"] = to
    s["revision"] += 1
    s["epoch"] += 1


def _downgrade(s, cause):
    if s["mode"] == "whole_song" and not s["downgrade"]:
        s["downgrade"] = cause


def _same_epoch(s, e):
    if e["epoch"] is not None and e["epoch"] != s["epoch"]:
        s["stale"] += 1
        raise Rejected("stale_epoch")


def _command(s, e):
    """True where the state changed."""
    kind, now = e["kind"], s["state"]
    if kind == "stop":
        if now not in TERMINAL:
            _go(s, "stopped")
            return True
        return False
    if now in TERMINAL:
        raise Rejected("terminal")
    if now in ("preparing", "interrupted"):
        raise Rejected("not_ready" if now == "preparing" else "device_unavailable")
    if kind == "seek":
        to = e["sample"]
        if to is None or not 0 <= to < s["duration"]:
            raise Rejected("out_of_range")
        if now != "playing" and to == s["position"]:
            return False
        if s["played"] or to:
            _downgrade(s, "seek")
        s["position"] = to
        _go(s, now)
        return True
    to = MOVES[now, kind]
    s["played"] |= kind == "play"
    if to != now:
        _go(s, to)
    return to != now


def _presented(s, e):
    _same_epoch(s, e)
    if s["state"] != "playing":
        raise Rejected("not_playing")
    if e["sample"] is None or e["sample"] > s["duration"]:
        raise Rejected("out_of_range")
    if e["sample"] < s["position"]:
        raise Rejected("position_regressed")
    s["position"] = e["sample"]
    if s["position"] == s["duration"]:
        _go(s, "finished")
    return True


def _credit(s, e):
    """Samples not credited before; touching spans join."""
    _same_epoch(s, e)
    start, end = e["sample"], e["end_sample"]
    if s["state"] != "playing":
        raise Rejected("not_playing")
    if start is None or end is None or not 0 <= start < end <= s["duration"]:
        raise Rejected("invalid_range")
    near = [c for c in s["credits"] if c[0] <= end and c[1] >= start]
    known = sum(min(b, end) - max(a, start) for a, b in near)
    joined = [min([start, *(a for a, _ in near)]), max([end, *(b for _, b in near)])]
    spans = sorted([c for c in s["credits"] if c not in near] + [joined])
    if len(spans) > CREDITS:
        raise Rejected("ledger_full")
    s["credits"] = spans
    return end - start - known


def _interrupt(s, e):
    _same_epoch(s, e)
    now = s["state"]
    if now in TERMINAL:
        raise Rejected("terminal")
    if now == "preparing":
        _go(s, "failed")
    elif now != "interrupted":
        s["resume"] = "ready" if now == "ready" else "paused"
        if s["played"]:
            _downgrade(s, "interrupted")
        _go(s, "interrupted")
    return now != "interrupted"


def _other(s, e):
    kind, now = e["kind"], s["state"]
    if kind == "prepared":
        if now == "preparing":
            s["state"] = "ready"
            s["revision"] += 1
        return now == "preparing"
    if kind == "fail":
        if now not in TERMINAL:
            _go(s, "failed")
        return now not in TERMINAL
    if kind == "recover":
        if now != "interrupted":
            raise Rejected("terminal" if now in TERMINAL else "not_ready")
        _go(s, s["resume"])
        return True
    raise Rejected("unknown_kind")


def _open(s, e):
    if s and s["state"] not in TERMINAL:
        raise Rejected("session_busy")
    if not e["sample"] or e["sample"] < 0:
        raise Rejected("invalid_duration")
    return {"state": "preparing", "mode": e["mode"] or "whole_song", "duration": e["sample"], "revision": 0, "epoch": 1, "position": 0, "resume": "ready", "played": False, "downgrade": None, "stale": 0, "credits": [], "commands": []}


def _shown(s):
    eligible = "practice" if s["mode"] == "practice" else f"downgraded:{s['downgrade']}" if s["downgrade"] else "whole_song"
    return [s["state"], s["revision"], s["epoch"], s["position"], eligible, s["stale"]]


def step(s, e):
    """A session's next state and the row that answers an event; a rejected event changes nothing but the count of stale ones."""
    fresh, error, what = None, None, "applied"
    try:
        if e["kind"] == "open":
            s = _open(s, e)
        elif s is None:
            raise Rejected("session_not_found")
        elif e["kind"] in COMMAND_KINDS:
            # A NaN-free list keeps what a command of one id said and what it was told.
            said = [e["kind"], e["sample"] if e["kind"] == "seek" else None]
            before = next((c for c in s["commands"] if c[0] == e["command_id"] is not None), None)
            if before:
                if before[1] != said:
                    raise Rejected("command_id_conflict")
                return s, (e["seq"], e["kind"], "replayed", None, *before[2], None)
            if e["kind"] != "stop" and e["expected_revision"] not in (None, s["revision"]):
                raise Rejected("stale_revision")
            what = "applied" if _command(s, e) else "no_op"
            if e["command_id"] is not None:
                s["commands"] = [*s["commands"], [e["command_id"], said, _shown(s)]][-COMMANDS:]
        elif e["kind"] == "credit":
            fresh = _credit(s, e)
        else:
            what = "applied" if {"presented": _presented, "interrupt": _interrupt}.get(e["kind"], _other)(s, e) else "no_op"
    except Rejected as r:
        what, error = "rejected", str(r)
    return s, (e["seq"], e["kind"], what, error, *(_shown(s) if s else [None] * 6), fresh)


def replay(events: DataFrame, key: str = "session_id") -> DataFrame:
    """The answer to each event (key, seq, kind, command_id, expected_revision, epoch, sample, end_sample, mode) of sessions.

    Kinds: open (sample is the duration, mode whole_song or practice), prepared,
    play, pause, seek, stop, presented, credit (sample to end_sample), interrupt,
    recover and fail. A repeated command id with the same content gets the first
    answer again, with another content it is a conflict. A null expected
    revision or epoch is not compared. Events of one seq keep any order.
    """
    return state.run(events.select(key, "seq", "kind", "command_id", "expected_revision", "epoch", "sample", "end_sample", "mode"), key, "seq", step, SCHEMA)


def _job(s, e):
    """Progress only grows, a terminal status is final; what changes nothing is no row."""
    now = s or {"status": None, "progress": -1.0}
    if now["status"] in ("succeeded", "failed", "cancelled"):
        return now, None
    progress = max(now["progress"], 0.0, min(1.0, e["progress"] or 0.0))
    new = {"status": e["status"], "progress": progress}
    return new, (None if new == now else (e["seq"], e["status"], progress))


def jobs(updates: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, seq, status, progress) of updates that change a job."""
    return state.run(updates.select(key, "seq", "status", "progress"), key, "seq", _job, "seq long, status string, progress double")


def _follow(s, e):
    """The first instance stays; a snapshot that is behind in revision, epoch or position is discarded."""
    mark = [e["revision"], e["epoch"], e["position"]]
    new = {"instance": e["instance"], "session": e["session_id"], "mark": mark}
    if s is None:
        return new, (e["seq"], "new_session")
    if e["instance"] != s["instance"]:
        return s, (e["seq"], "wrong_instance")
    if e["session_id"] != s["session"]:
        return new, (e["seq"], "new_session")
    revision, epoch, position = s["mark"]
    if mark[0] < revision:
        return s, (e["seq"], "stale_revision")
    if mark[1] < epoch:
        return s, (e["seq"], "stale_epoch")
    if mark[:2] == [revision, epoch] and e["state"] == "playing" and mark[2] < position:
        return s, (e["seq"], "regressed")
    return new, (e["seq"], "epoch_advanced" if mark[1] > epoch else "applied")


def follow(snapshots: DataFrame, key: str = "client_id") -> DataFrame:
    """(key, seq, result) of each snapshot (key, seq, instance, session_id, state, revision, epoch, position) a client receives."""
    return state.run(snapshots.select(key, "seq", "instance", "session_id", "state", "revision", "epoch", "position"), key, "seq", _follow, "seq long, result string")


def _deliver(s, e):
    """Backlog and live rows once each; a hole is marked, and a terminal state ends the log."""
    last, closed = s or (0, False)
    if closed or e["event_seq"] <= last:
        return (last, closed), None
    return (e["event_seq"], e["state"] in TERMINAL), (e["seq"], e["event_seq"], e["state"], e["event_seq"] > last + 1)


def deliver(log: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, seq, event_seq, state, gap) of a log (key, seq in order of arrival, event_seq, state) whose backlog and live parts overlap."""
    return state.run(log.select(key, "seq", "event_seq", "state"), key, "seq", _deliver, "seq long, event_seq long, state string, gap boolean")
