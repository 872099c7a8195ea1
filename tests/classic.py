"""Writes small NetCDF files of the classic formats."""

import numpy as np

CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "i8": 10}


def write(path, dims, variables, version=1):
    """dims: name -> size, or None for the record dimension; variables: (name, dims, array, attributes)."""
    wide = 8 if version == 5 else 4
    number = lambda n, w=4: int(n).to_bytes(w, "big")
    padded = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: number(len(s.encode()), wide) + padded(s.encode())
    kind = lambda a: a.dtype.str[1:]
    big = lambda a: np.asarray(a, a.dtype.newbyteorder(">")).tobytes()

    def attributes(of):
        out = number(12) + number(len(of), wide) if of else number(0) + number(0, wide)
        for k, v in of.items():
            if isinstance(v, str):
                out += name(k) + number(2) + number(len(v), wide) + padded(v.encode())
            else:
                v = np.atleast_1d(v)
                out += name(k) + number(CODES[kind(v)]) + number(len(v), wide) + padded(big(v))
        return out

    order = list(dims)
    records = next((v[2].shape[0] for v in variables if v[1] and dims[v[1][0]] is None), 0)
    is_record = [bool(v[1]) and dims[v[1][0]] is None for v in variables]
    slabs = [len(big(v[2])) // (max(1, records) if r else 1) for v, r in zip(variables, is_record, strict=True)]
    several = sum(is_record) > 1
    pad = [-(-s // 4) * 4 if not r or several else s for s, r in zip(slabs, is_record, strict=True)]

    def head(begins):
        out = b"CDF" + bytes([version]) + number(records, wide) + number(10) + number(len(dims), wide)
        out += b"".join(name(d) + number(dims[d] or 0, wide) for d in order) + attributes({"title": "a test"}) + number(11) + number(len(variables), wide)
        for (n, of, a, attrs), size, begin in zip(variables, pad, begins, strict=True):
            out += name(n) + number(len(of), wide) + b"".join(number(order.index(d), wide) for d in of) + attributes(attrs) + number(CODES[kind(a)]) + number(size, wide) + number(begin, 4 if version == 1 else 8)
        return out

    at, begins = len(head([0] * len(variables))), [0] * len(variables)
    for records_too in (False, True):
        for i, r in enumerate(is_record):
            if r == records_too:
                begins[i] = at
                at += pad[i]
    body = bytearray(head(begins))
    for i, r in enumerate(is_record):
        if not r:
            body += big(variables[i][2]).ljust(pad[i], b"\0")
    for k in range(records):
        for i, r in enumerate(is_record):
            if r:
                body += big(variables[i][2][k]).ljust(pad[i], b"\0")
    with open(path, "wb") as f:
        f.write(bytes(body))
