"""Edit commands on a song's notes and lyrics: ordered, all or nothing per command."""
from operator import itemgetter

from pyspark.sql import DataFrame

from .groups import pair

MOST = 1024
_ITEM = "kind string, id string, start_sample long, end_sample long, text string, midi_note long, lyric_id string, confidence double, timing_confidence double, source string"


def _faults(op, held, lyrics, duration):
    """Codes of what is wrong with one operation, given the items that earlier ones left."""
    known, verb, note = op["id"] in held, op["verb"], op["kind"] == "note"
    if verb == "delete":
        return [] if known else ["unknown_id"]
    found = []
    if verb == "add" and not (op["id"] or "").strip():
        found.append("empty_id")
    start, end = op["start_sample"], op["end_sample"]
    if start is None or end is None or start < 0 or start >= end:
        found.append("invalid_range")
    elif end > duration:
        found.append("out_of_song")
    if note and (op["midi_note"] is None or not 0 <= op["midi_note"] <= 127):
        found.append("invalid_midi_note")
    if not note and not (op["text"] or "").strip():
        found.append("empty_text")
    if note and verb == "add" and op["lyric_id"] is not None and op["lyric_id"] not in lyrics:
        found.append("missing_lyric_ref")
    if (verb == "add") == known:
        found.append("duplicate_id" if known else "unknown_id")
    return found


def _changed(op, old):
    """The item after an operation: an edited text, pitch or time loses its confidence."""
    keep = {"kind": op["kind"], "id": op["id"], "start_sample": op["start_sample"], "end_sample": op["end_sample"], "text": op["text"], "midi_note": op["midi_note"]}
    if old is None:
        return keep | {"lyric_id": op["lyric_id"], "confidence": None, "timing_confidence": None, "source": "manual"}
    content, span = ("midi_note",) if op["kind"] == "note" else ("text",), ("start_sample", "end_sample")
    same = lambda cs: all(op[c] == old[c] for c in cs)
    timing = old["timing_confidence"] if op["kind"] == "note" or same(span) else None
    return old | keep | {"confidence": old["confidence"] if same(content) else None, "timing_confidence": timing, "source": "manual"}


def apply_edits(items: DataFrame, ops: DataFrame, key: str = "song_id") -> DataFrame:
    """Songs after a command's operations, or the faults that reject it.

    Takes items (key, kind note or lyric, id, start_sample, end_sample, text,
    midi_note, lyric_id, confidence, timing_confidence, source) and ops (key,
    op, kind, verb add, update or delete, id, start_sample, end_sample, text,
    midi_note, lyric_id, duration), a command per song. Returns a row per item
    (op and code null) in order of start, end and id; where any operation fails,
    the items as they were and a row per fault with its op and code. A note
    whose line was deleted rejects the command too (op null). More than 1,024
    operations are too many. A song without operations stays as it is.
    """

    def step(rows, todo):
        held = {"note": {}, "lyric": {}}
        for r in rows:
            held[r["kind"]][r["id"]] = r
        faults = [(None, "too_many_ops")] if len(todo) > MOST else []
        for op in todo if not faults else []:
            own = held.get(op["kind"])
            bad = ["unknown_kind"] if own is None or op["verb"] not in ("add", "update", "delete") else _faults(op, own, held["lyric"], op["duration"])
            if bad:
                faults += [(op["op"], code) for code in bad]
            elif op["verb"] == "delete":
                own.pop(op["id"])
            else:
                own[op["id"]] = _changed(op, own.get(op["id"]))
        after = [*held["lyric"].values(), *held["note"].values()]
        if todo and not faults:
            faults = [(None, "missing_lyric_ref") for n in after if n["lyric_id"] is not None and n["lyric_id"] not in held["lyric"]]
        for r in sorted(rows if faults else after, key=in_time):
            yield *values(r), None, None
        for op, code in faults:
            yield *bare, op, code

    names = [c.split()[0] for c in _ITEM.split(", ")]
    in_time, values, bare = itemgetter("start_sample", "end_sample", "id", "kind"), itemgetter(*names), (None,) * len(names)
    wanted = ["op", "kind", "verb", "id", "start_sample", "end_sample", "text", "midi_note", "lyric_id", "duration"]
    return pair(items.select(key, *names), ops.select(key, *wanted), key, (["start_sample", "end_sample", "id"], ["op"]), step, _ITEM + ", op long, code string")
