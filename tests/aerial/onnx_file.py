"""Small ONNX files, written without the ONNX package: just the messages that a graph of plain operators needs."""

import struct

FLOAT, INT64 = 1, 7


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor(name, values, kind, shape):
    raw = struct.pack(f"<{len(values)}{'f' if kind == FLOAT else 'q'}", *values)
    return b"".join(field(1, d) for d in shape) + field(2, kind) + field(8, name) + field(9, raw)


def attribute(name, value):
    if isinstance(value, int):
        return field(1, name) + field(3, value) + field(20, 2)
    return field(1, name) + b"".join(field(8, v) for v in value) + field(20, 7)


def node(kind, inputs, output, **attributes):
    return b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, kind) + b"".join(field(5, attribute(k, v)) for k, v in attributes.items())


def value(name, kind, rank):
    shape = b"".join(field(1, field(2, f"{name}_{k}")) for k in range(rank))
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def model(nodes, inputs, outputs, constants):
    graph = b"".join(field(1, n) for n in nodes) + field(2, "graph") + b"".join(field(5, tensor(*c)) for c in constants)
    graph += b"".join(field(11, value(*i)) for i in inputs) + b"".join(field(12, value(*o)) for o in outputs)
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def bright_pixels(least):
    """A detector: every pixel above ``least``, its value as the score, and the value and its square as descriptor."""
    nodes = [
        node("Greater", ["image", "least"], "bright"),
        node("NonZero", ["bright"], "where"),
        node("Gather", ["where", "axes"], "rows", axis=0),
        node("Transpose", ["rows"], "points", perm=[1, 0]),
        node("Unsqueeze", ["points", "first"], "keypoints"),
        node("Transpose", ["where"], "at", perm=[1, 0]),
        node("GatherND", ["image", "at"], "flat"),
        node("Unsqueeze", ["flat", "first"], "scores"),
        node("Unsqueeze", ["flat", "second"], "column"),
        node("Mul", ["column", "column"], "square"),
        node("Concat", ["column", "square"], "both", axis=1),
        node("Unsqueeze", ["both", "first"], "descriptors"),
    ]
    constants = [("least", [least], FLOAT, []), ("axes", [3, 2], INT64, [2]), ("first", [0], INT64, [1]), ("second", [1], INT64, [1])]
    return model(nodes, [("image", FLOAT, 4)], [("keypoints", INT64, 3), ("scores", FLOAT, 2), ("descriptors", FLOAT, 3)], constants)


def like_pairs(least):
    """A matcher: every two features whose descriptors' product is above ``least``, with the product as score."""
    nodes = [
        node("Transpose", ["desc1"], "turned", perm=[0, 2, 1]),
        node("MatMul", ["desc0", "turned"], "product"),
        node("Greater", ["product", "least"], "like"),
        node("NonZero", ["like"], "where"),
        node("Gather", ["where", "axes"], "rows", axis=0),
        node("Transpose", ["rows"], "matches0", perm=[1, 0]),
        node("Transpose", ["where"], "at", perm=[1, 0]),
        node("GatherND", ["product", "at"], "mscores0"),
        node("Identity", ["kpts0"], "seen0"),
        node("Identity", ["kpts1"], "seen1"),
    ]
    inputs = [(n, FLOAT, 3) for n in ("kpts0", "kpts1", "desc0", "desc1")]
    return model(nodes, inputs, [("matches0", INT64, 2), ("mscores0", FLOAT, 1)], [("least", [least], FLOAT, []), ("axes", [1, 2], INT64, [2])])
