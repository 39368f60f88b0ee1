"""Whole queries against plain programs on the smallest tables, where there is no SQL; and dense overlaps against all pairs."""

import json
from collections import Counter, defaultdict

import pytest
from conftest import oracle

from talkgrid.operators import overlap
from talkgrid.plans import catalog

SF = "/root/testdata/sf0.001"
KEYS = {"file_id", "start", "end", "speaker_id"}


def missing(v):
    return v is None or v in ("", "NaN")


def kind(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else {str: "string", dict: "object", list: "array"}[type(v)]


def equal(x, y):
    """Whether two values agree, and whether they are values."""
    if missing(x) and missing(y):
        return True, False
    return not missing(x) and not missing(y) and kind(x) == kind(y) and x == y, True


def changes(lines):
    exports = defaultdict(lambda: defaultdict(dict))
    for export, artefact, station, written, payload in lines:
        own = exports[station, artefact][written, export]
        try:
            record = json.loads(payload)
        except (TypeError, ValueError):
            continue
        if isinstance(record, dict):
            own[payload] = record
    out = []
    for (_, artefact), own in exports.items():
        before = None
        for _, export in sorted(own):
            records = list(own[_, export].values())
            fields = {k for r in records for k in r} - KEYS
            types, held = {}, defaultdict(list)
            for f in fields:
                votes = Counter(kind(r[f]) for r in records if not missing(r.get(f)))
                types[f] = min(votes, key=lambda k: (-votes[k], k)) if votes else (before[1].get(f) if before else None)
            for r in records:
                key = (r.get("file_id"), r.get("speaker_id"), r.get("start") if artefact == "segments" else 0)
                if not any(map(missing, key)):
                    held[key].append(r)
            if before:
                old_fields, old_types, old_held = before
                renamed = []
                for a in old_fields - fields:
                    for b in fields - old_fields:
                        seen = [equal(q.get(a), r.get(b)) for k in held.keys() & old_held.keys() for r in held[k] for q in old_held[k]]
                        if seen and all(s for s, _ in seen) and any(v for _, v in seen):
                            renamed.append((a, b))
                out += [(export, b, "renamed") for _, b in renamed]
                out += [(export, f, "removed") for f in old_fields - fields - {a for a, _ in renamed}]
                out += [(export, f, "added") for f in fields - old_fields - {b for _, b in renamed}]
                out += [(export, f, "retyped") for f in fields & old_fields if types[f] and old_types.get(f) and types[f] != old_types[f]]
            before = fields, types, held
    return sorted(out)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_drift(spark, sf):
    lines = oracle(sf).execute("SELECT export_id, artefact, station, written_at, payload FROM raw_exports").fetchall()
    want = changes(lines)
    assert sorted(map(tuple, catalog.QUERIES["p2_found"](spark, sf).collect())) == want and len(want) > 5


@pytest.mark.parametrize("speakers,turns,gap,length", [(3, 10, 120, 450), (5, 45, 20, 1100)])
def test_dense_turns(spark, speakers, turns, gap, length):
    data = [("f", t, f"S{t % speakers}", t * gap, t * gap + length + t % 5 * 10) for t in range(speakers * turns)]
    df = spark.createDataFrame(data, "file_id string, idx bigint, speaker_id string, s bigint, e bigint")
    total, by, cuts = 0, Counter(), []
    for i, a in enumerate(data):
        for b in data[i + 1 :]:
            shared = min(a[4], b[4]) - max(a[3], b[3])
            if shared >= 50:
                total += shared
                by[a[2]] += shared
                by[b[2]] += shared
                if a[2] != b[2] and b[3] - a[3] <= 150:
                    cuts.append((b[3], b[2], a[2], shared) if b[3] > a[3] else (b[3], a[2], b[2], shared))
    assert overlap.overlap_totals(df).first().overlap_ms == total
    pairs = overlap.pairs(df)
    assert {r.speaker_id: r.overlap_ms for r in overlap.overlap_by_speaker(pairs).collect()} == dict(by)
    assert sorted((r.at_ms, r.interrupter, r.interrupted, r.overlap_ms) for r in overlap.interruptions(pairs).collect()) == sorted(cuts)
