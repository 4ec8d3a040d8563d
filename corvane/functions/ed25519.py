"""Ed25519 after RFC 8032, in plain integers; for a few signatures a file, not for bulk work."""

from __future__ import annotations

import hashlib

_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_I = pow(2, (_P - 1) // 4, _P)


def _x(y: int, sign: int) -> int | None:
    xx = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(xx, (_P + 3) // 8, _P)
    if (x * x - xx) % _P:
        x = x * _I % _P
    if (x * x - xx) % _P or (x == 0 and sign):
        return None
    return _P - x if x & 1 != sign else x


_BY = 4 * pow(5, -1, _P) % _P
_BX = _x(_BY, 0)
_BASE = (_BX, _BY, 1, _BX * _BY % _P)


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n: int, p):
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p = _add(p, p)
        n >>= 1
    return out


def _pack(p) -> bytes:
    z = pow(p[2], -1, _P)
    x, y = p[0] * z % _P, p[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes):
    n = int.from_bytes(raw, "little")
    y = n & (1 << 255) - 1
    x = _x(y, n >> 255) if y < _P else None
    return None if x is None else (x, y, 1, x * y % _P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(key: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(key).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def public_key(secret: bytes) -> bytes:
    return _pack(_times(_secret(secret)[0], _BASE))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _secret(secret)
    public = _pack(_times(a, _BASE))
    r = _hash(prefix, message) % _L
    head = _pack(_times(r, _BASE))
    return head + ((r + _hash(head, public, message) * a) % _L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    k = _hash(signature[:32], public, message) % _L
    left, right = _times(s, _BASE), _add(r, _times(k, a))
    return (left[0] * right[2] - right[0] * left[2]) % _P == 0 and (left[1] * right[2] - right[1] * left[2]) % _P == 0
