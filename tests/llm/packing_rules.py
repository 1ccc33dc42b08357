"""What every packing must hold."""


def check_packing(rows, capacity=2048):
    """Sequences without gaps and within the capacity; their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)
