"""Vector grammars: SVG paths, transforms, viewports, and PDF functions."""

from __future__ import annotations

import math
import re

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_ARGS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


def multiply(m, n):
    """First n, then m: the product as SVG writes it."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f


def transform(s: str) -> tuple[float, ...]:
    """The matrix of a transform list; what can't be read ends the list."""
    out, at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), 0
    for m in re.finditer(r"[\s,]*([A-Za-z]+)\s*\(([^)]*)\)", s):
        if m.start() != at:
            break
        at, v = m.end(), [float(x) for x in _NUMBER.findall(m[2])]
        if m[1] == "matrix" and len(v) == 6:
            n = tuple(v)
        elif m[1] == "translate" and len(v) in (1, 2):
            n = (1, 0, 0, 1, v[0], v[1] if len(v) > 1 else 0)
        elif m[1] == "scale" and len(v) in (1, 2):
            n = (v[0], 0, 0, v[-1], 0, 0)
        elif m[1] == "rotate" and len(v) in (1, 3):
            k = math.radians(v[0])
            n = (math.cos(k), math.sin(k), -math.sin(k), math.cos(k), 0, 0)
            if len(v) == 3:
                n = multiply(multiply((1, 0, 0, 1, v[1], v[2]), n), (1, 0, 0, 1, -v[1], -v[2]))
        elif m[1] == "skewX" and len(v) == 1:
            n = (1, 0, math.tan(math.radians(v[0])), 1, 0, 0)
        elif m[1] == "skewY" and len(v) == 1:
            n = (1, math.tan(math.radians(v[0])), 0, 1, 0, 0)
        else:
            break
        out = multiply(out, n)
    return out


def path_segments(d: str) -> list[tuple[str, list[float]]]:
    """Absolute moves M, lines L, cubics C and closes Z of path data, up to the first mistake."""
    out, i, x, y, sx, sy, last, ctrl = [], 0, 0.0, 0.0, 0.0, 0.0, "", None

    def numbers(n, flags=False):
        nonlocal i
        got = []
        for k in range(n):
            m = re.compile(r"[\s,]*([01])").match(d, i) if flags and k in (3, 4) else re.compile(r"[\s,]*(" + _NUMBER.pattern + ")").match(d, i)
            if not m:
                return None
            got.append(float(m[1]))
            i = m.end()
        return got

    while True:
        m = re.compile(r"[\s,]*([A-Za-z])").match(d, i)
        if m:
            cmd, i = m[1], m.end()
            if cmd.upper() not in _ARGS or not out and cmd.upper() != "M":
                return out
        elif not last or last in "Zz" or not re.compile(r"[\s,]*[+\-.\d]").match(d, i):
            return out
        else:
            cmd = {"M": "L", "m": "l"}.get(last, last)
        up, rel = cmd.upper(), cmd.islower()
        v = numbers(_ARGS[up], up == "A")
        if v is None:
            return out
        ox, oy = (x, y) if rel else (0.0, 0.0)
        if up == "Z":
            out.append(("Z", []))
            x, y = sx, sy
        elif up == "H":
            x = ox + v[0]
            out.append(("L", [x, y]))
        elif up == "V":
            y = oy + v[0]
            out.append(("L", [x, y]))
        elif up == "A":
            ex, ey = ox + v[5], oy + v[6]
            out += arc(x, y, abs(v[0]), abs(v[1]), v[2], bool(v[3]), bool(v[4]), ex, ey)
            x, y = ex, ey
        else:
            p = [(ox if k % 2 == 0 else oy) + a for k, a in enumerate(v)]
            if up in ("S", "T"):
                smooth = last.upper() in (("C", "S") if up == "S" else ("Q", "T")) and ctrl
                p = [2 * x - ctrl[0], 2 * y - ctrl[1], *p] if smooth else [x, y, *p]
            if up in ("C", "S"):
                ctrl = p[2], p[3]
                out.append(("C", p))
            elif up in ("Q", "T"):
                ctrl = p[0], p[1]
                out.append(("C", [x + 2 / 3 * (p[0] - x), y + 2 / 3 * (p[1] - y), p[2] + 2 / 3 * (p[0] - p[2]), p[3] + 2 / 3 * (p[1] - p[3]), p[2], p[3]]))
            else:
                out.append((up, p))
            x, y = p[-2], p[-1]
            if up == "M":
                sx, sy = x, y
        last = cmd


def arc(x, y, rx, ry, angle, large, sweep, ex, ey) -> list[tuple[str, list[float]]]:
    """An elliptic arc as cubics of at most a quarter turn."""
    if (x, y) == (ex, ey):
        return []
    if not rx or not ry:
        return [("L", [ex, ey])]
    k = math.radians(angle)
    c, s = math.cos(k), math.sin(k)
    dx, dy = (x - ex) / 2, (y - ey) / 2
    px, py = c * dx + s * dy, c * dy - s * dx
    grow = (px / rx) ** 2 + (py / ry) ** 2
    if grow > 1:
        rx, ry = rx * math.sqrt(grow), ry * math.sqrt(grow)
    n = rx * rx * ry * ry - rx * rx * py * py - ry * ry * px * px
    f = math.sqrt(max(0.0, n / (rx * rx * py * py + ry * ry * px * px))) * (-1 if large == sweep else 1)
    qx, qy = f * rx * py / ry, -f * ry * px / rx
    cx, cy = c * qx - s * qy + (x + ex) / 2, s * qx + c * qy + (y + ey) / 2
    t0 = math.atan2((py - qy) / ry, (px - qx) / rx)
    dt = math.atan2((-py - qy) / ry, (-px - qx) / rx) - t0
    dt += 2 * math.pi if sweep and dt < 0 else -2 * math.pi if not sweep and dt > 0 else 0
    steps, out = max(1, math.ceil(abs(dt) / (math.pi / 2) - 1e-9)), []
    step = dt / steps
    h = 4 / 3 * math.tan(step / 4)
    at = lambda u, v: (c * rx * u - s * ry * v + cx, s * rx * u + c * ry * v + cy)
    for j in range(steps):
        a, b = t0 + j * step, t0 + (j + 1) * step
        p1 = at(math.cos(a) - h * math.sin(a), math.sin(a) + h * math.cos(a))
        p2 = at(math.cos(b) + h * math.sin(b), math.sin(b) - h * math.cos(b))
        out.append(("C", [*p1, *p2, *at(math.cos(b), math.sin(b))]))
    out[-1][1][-2:] = [ex, ey]
    return out


def bounds(segments, m=(1.0, 0.0, 0.0, 1.0, 0.0, 0.0)):
    """The box of a path's points, control points of curves by their extremes; None if there are none."""
    xs, ys, now = [], [], (0.0, 0.0)
    on = lambda x, y: (m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])
    for op, v in segments:
        if op == "Z":
            continue
        pts = [on(a, b) for a, b in zip(v[::2], v[1::2], strict=True)]
        if op == "C":
            for k, into in ((0, xs), (1, ys)):
                p0, p1, p2, p3 = now[k], pts[0][k], pts[1][k], pts[2][k]
                a, b, c = -p0 + 3 * p1 - 3 * p2 + p3, 2 * (p0 - 2 * p1 + p2), p1 - p0
                roots = [-c / b] if abs(a) < 1e-12 and b else [] if abs(a) < 1e-12 else [(-b + s * math.sqrt(b * b - 4 * a * c)) / (2 * a) for s in (1, -1)] if b * b >= 4 * a * c else []
                into += [(1 - t) ** 3 * p0 + 3 * (1 - t) ** 2 * t * p1 + 3 * (1 - t) * t * t * p2 + t**3 * p3 for t in roots if 0 < t < 1]
        now = pts[-1]
        xs.append(now[0])
        ys.append(now[1])
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None


def viewport(box, width: float, height: float, align: str = "xMidYMid", slice_: bool = False):
    """The matrix that fits a viewBox (x, y, w, h) into a viewport."""
    x, y, w, h = box
    if w <= 0 or h <= 0:
        return (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    sx, sy = width / w, height / h
    if align == "none":
        return (sx, 0.0, 0.0, sy, -x * sx, -y * sy)
    k = max(sx, sy) if slice_ else min(sx, sy)
    part = {"Min": 0.0, "Mid": 0.5, "Max": 1.0}
    return (k, 0.0, 0.0, k, -x * k + (width - w * k) * part[align[1:4]], -y * k + (height - h * k) * part[align[5:8]])


# -- PDF functions ----------------------------------------------------------------------------


def _clip(v, ranges):
    return [min(max(a, ranges[2 * k]), ranges[2 * k + 1]) for k, a in enumerate(v[: len(ranges) // 2])] if ranges else v


def evaluate(f: dict, inputs: list[float], samples: bytes = b"") -> list[float]:
    """A function of type 0 (sampled), 2 (exponential), 3 (stitching) or 4 (calculator), given as a plain dictionary."""
    x = _clip(inputs, f["Domain"])
    kind = f["FunctionType"]
    if kind == 2:
        c0, c1, n = f.get("C0", [0.0]), f.get("C1", [1.0]), f.get("N", 1)
        out = [a + x[0] ** n * (b - a) for a, b in zip(c0, c1, strict=True)] if x[0] or n > 0 else list(c0)
    elif kind == 3:
        cuts = [f["Domain"][0], *f["Bounds"], f["Domain"][1]]
        k = max((i for i in range(len(f["Functions"])) if x[0] >= cuts[i]), default=0)
        lo, hi, e0, e1 = cuts[k], cuts[k + 1], f["Encode"][2 * k], f["Encode"][2 * k + 1]
        sub = f["Functions"][k]
        out = evaluate(sub, [e0 if hi == lo else e0 + (x[0] - lo) * (e1 - e0) / (hi - lo)], sub.get("#data", b""))
    elif kind == 0:
        out = _sampled(f, x, samples)
    elif kind == 4:
        out = calculator(f["#program"], x)
    else:
        return []
    return _clip(out, f.get("Range"))


def _sampled(f, x, data):
    size, bits, m = f["Size"], f["BitsPerSample"], len(f["Range"]) // 2
    encode = f.get("Encode") or [v for s in size for v in (0, s - 1)]
    decode, dom = f.get("Decode") or f["Range"], f["Domain"]
    at = [min(max(encode[2 * k] + (v - dom[2 * k]) * (encode[2 * k + 1] - encode[2 * k]) / ((dom[2 * k + 1] - dom[2 * k]) or 1), 0), size[k] - 1) for k, v in enumerate(x)]

    def sample(index, j):
        pos = (index * m + j) * bits
        whole = int.from_bytes(data[pos // 8 : (pos + bits + 7) // 8], "big")
        return whole >> (-(pos + bits) % 8) & ((1 << bits) - 1)

    out = []
    for j in range(m):
        total = 0.0
        for corner in range(1 << len(at)):
            w, index, step = 1.0, 0, 1
            for k, v in enumerate(at):
                lo = min(int(v), max(0, size[k] - 2))
                hi = corner >> k & 1
                w *= v - lo if hi else 1 - (v - lo)
                index, step = index + min(lo + hi, size[k] - 1) * step, step * size[k]
            if w:
                total += w * sample(index, j)
        out.append(decode[2 * j] + total * (decode[2 * j + 1] - decode[2 * j]) / ((1 << bits) - 1))
    return out


def program(text: str):
    """A calculator's program as nested lists."""
    stack: list[list] = [[]]
    for t in re.findall(r"[{}]|[^\s{}]+", text):
        if t == "{":
            stack.append([])
        elif t == "}" and len(stack) > 1:
            done = stack.pop()
            stack[-1].append(done)
        elif t != "}":
            stack[-1].append(float(t) if _NUMBER.fullmatch(t) else t)
    return stack[0][0] if stack[0] and isinstance(stack[0][0], list) else stack[0]


def calculator(prog, inputs, most: int = 100) -> list[float]:
    """Runs a program; a stack that is too small or too large ends it with what is there."""
    s = list(inputs)
    one = {
        "abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc, "sqrt": lambda a: math.sqrt(max(0, a)), "sin": lambda a: 0.0 if a % 180 == 0 else math.sin(math.radians(a)),
        "cos": lambda a: 0.0 if a % 180 == 90 else math.cos(math.radians(a)), "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0, "cvi": math.trunc, "cvr": float, "not": lambda a: not a if isinstance(a, bool) else ~int(a),
    }
    two = {
        "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0, "idiv": lambda a, b: int(a / b) if b else 0, "mod": lambda a, b: math.fmod(a, b) if b else 0,
        "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "exp": lambda a, b: a**b if a > 0 or b == int(b) and (a or b > 0) else 0.0, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
        "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "and": lambda a, b: a and b if isinstance(a, bool) else int(a) & int(b), "or": lambda a, b: a or b if isinstance(a, bool) else int(a) | int(b),
        "xor": lambda a, b: a != b if isinstance(a, bool) else int(a) ^ int(b), "bitshift": lambda a, b: int(a) << int(b) if b >= 0 else int(a) >> int(-b),
    }

    def run(p, depth=0):
        for k, t in enumerate(p):
            if isinstance(t, (list, float)):
                if isinstance(t, float):
                    s.append(t)
            elif t in ("if", "ifelse"):
                branches = p[k - (2 if t == "ifelse" else 1) : k]
                if s.pop():
                    run(branches[0], depth + 1)
                elif t == "ifelse":
                    run(branches[1], depth + 1)
            elif t in ("true", "false"):
                s.append(t == "true")
            elif t in one:
                s.append(one[t](s.pop()))
            elif t in two:
                b, a = s.pop(), s.pop()
                s.append(two[t](a, b))
            elif t == "pop":
                s.pop()
            elif t == "dup":
                s.append(s[-1])
            elif t == "exch":
                s[-2:] = s[-1], s[-2]
            elif t == "copy":
                n = int(s.pop())
                s.extend(s[-n:] if n else [])
            elif t == "index":
                s.append(s[-1 - int(s.pop())])
            elif t == "roll":
                j, n = int(s.pop()), int(s.pop())
                if n > 0:
                    top = s[-n:]
                    s[-n:] = top[-j % n :] + top[: -j % n] if j % n else top
            if len(s) > most:
                return

    try:
        run(prog)
    except (IndexError, OverflowError, ValueError):
        pass
    return [float(v) for v in s]
