"""Folders of the given tables."""

SMALL, MIDDLE, LARGER = (f"/root/testdata/sf{s}" for s in ("0.001", "0.01", "0.1"))
