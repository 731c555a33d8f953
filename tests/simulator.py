"""A step-by-step model of the stream operators in plain Python, for comparison."""

from collections import defaultdict


def moving(values, function, n):
    kept, out = [], []
    for v in values:
        if v is None:
            out.append(None)
            continue
        kept = [*kept, v][-n:]
        out.append({"avg": sum(kept) / len(kept), "min": min(kept), "max": max(kept)}[function])
    return out


def sliding(events, averaged, size, slide):
    """events: dicts sorted by seq. Emits a window's row when stream time reaches its end; (results, markers)."""
    latest = max((e["ts"] for e in events), default=0)
    by_key = defaultdict(list)
    for e in events:
        by_key[e["key"]].append(e)
    results, markers = [], []
    for key, own in by_key.items():
        starts = sorted({(e["ts"] // slide - o) * slide for e in own for o in range(size // slide)})
        emitted = None
        for start in starts:
            if start + size > latest:
                continue
            inside = [e for e in own if start <= e["ts"] < start + size and all(e[a] is not None for a in averaged)]
            if not inside or inside[-1]["seq"] == emitted:
                markers.append(start)
                continue
            last = inside[-1]
            emitted = last["seq"]
            results.append((key, last["ts"], *[round(sum(e[a] for e in inside) / len(inside), 9) for a in averaged]))
    return sorted(results), sorted(markers)
