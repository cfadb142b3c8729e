"""Runs registered queries and their DuckDB SQL over the same tables and compares rows."""

import hashlib
import os
import struct

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if hasattr(x, "as_tuple"):
        return int(x) if x == int(x) else float(x)
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=str)


def differences(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    con = duck(sf_dir).execute(sql)
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(got.columns)
    wanted = rows(names, con.fetchall())
    assert len(found) == len(wanted)
    return [(a, b) for a, b in zip(found, wanted, strict=True) if a != b]


def plain_hash(layout, *fields):
    """64-bit BLAKE2b of packed fields by the standard library."""
    bits = {"Q": (1 << 64) - 1, "I": (1 << 32) - 1}
    return int.from_bytes(hashlib.blake2b(struct.pack("<" + layout, *(x & bits[k] for k, x in zip(layout, fields, strict=True))), digest_size=8).digest(), "little")
