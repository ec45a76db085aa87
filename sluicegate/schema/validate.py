"""Structural validation: accepted keys, types, enums and bounds, with paths in the messages."""

from __future__ import annotations

import re

from .errors import SchemaError

ENCODINGS = ("utf-8", "iso-8859-1", "windows-1252")
_VERSION = re.compile(r"[a-z]+\.2\.1")


class Obj:
    """An object with known keys; ``any_of`` lists alternatives of which exactly one key is there."""

    def __init__(self, keys: dict, required=(), one_of=(), open_=False):
        self.keys, self.required, self.one_of, self.open = keys, required, one_of, open_


class Arr:
    def __init__(self, item, least=0):
        self.item, self.least = item, least


class Int:
    def __init__(self, least):
        self.least = least


class Str:
    def __init__(self, least=0, enum=None, exact=None):
        self.least, self.enum, self.exact = least, enum, exact


class Bool:
    pass


class Any_:
    pass


class Ref:
    """A shape that is defined later."""

    def __init__(self, get):
        self.get = get


def check(v, shape, path: str, out: list[str]) -> None:
    if isinstance(shape, Ref):
        shape = shape.get()
    if isinstance(shape, Obj):
        if not isinstance(v, dict):
            out.append(f"{path}: must be an object")
            return
        out += [f"{path}: {k} is required" for k in shape.required if k not in v]
        for group in shape.one_of:
            n = sum(k in v for k in group)
            if n != 1:
                out.append(f"{path}: exactly one of {', '.join(group)} must be given")
        for k, x in v.items():
            if k in shape.keys:
                check(x, shape.keys[k], f"{path}.{k}", out)
            elif k != "_comment" and not shape.open:
                out.append(f"{path}: unknown key {k}")
    elif isinstance(shape, Arr):
        if not isinstance(v, list):
            out.append(f"{path}: must be an array")
            return
        if len(v) < shape.least:
            out.append(f"{path}: must have at least {shape.least} items")
        for i, x in enumerate(v):
            check(x, shape.item, f"{path}[{i}]", out)
    elif isinstance(shape, Int):
        if isinstance(v, bool) or not isinstance(v, int):
            out.append(f"{path}: must be an integer")
        elif v < shape.least:
            out.append(f"{path}: must be at least {shape.least}")
    elif isinstance(shape, Str):
        if not isinstance(v, str):
            out.append(f"{path}: must be a string")
        elif shape.exact is not None and len(v) != shape.exact:
            out.append(f"{path}: must have {shape.exact} character")
        elif len(v) < shape.least:
            out.append(f"{path}: must not be empty")
        elif shape.enum and v not in shape.enum:
            out.append(f"{path}: must be one of {', '.join(shape.enum)}")
    elif isinstance(shape, Bool) and not isinstance(v, bool):
        out.append(f"{path}: must be true or false")


_name, _pattern, _pos = Str(1), Str(1), Int(1)
_CSV = Obj({"delimiter": Str(exact=1), "replace_double_quotes": Bool(), "header_row_index": _pos, "data_row_index": _pos, "columns": Arr(Obj({"name": _name, "alias": _name}, ["name"]))}, ["delimiter", "data_row_index", "columns"])
_CSV2_COLUMN = Obj({"name": _name, "index": _pos, "line_index": _pos, "line_pattern": _pattern}, ["name"])
_CSV2_RECORD = Obj({"name": _name, "type": Str(enum=("record", "record_group")), "rows": _pos, "header": _pattern, "footer": _pattern, "is_target": Bool(), "min": Int(0), "max": Int(-1), "columns": Arr(_CSV2_COLUMN), "child_records": Arr(Ref(lambda: _CSV2_RECORD))})
_CSV2 = Obj({"delimiter": Str(exact=1), "replace_double_quotes": Bool(), "records": Arr(_CSV2_RECORD)}, ["delimiter", "records"])
_FIXED_COLUMN = Obj({"name": _name, "start_pos": _pos, "length": _pos, "line_index": _pos, "line_pattern": _pattern}, ["name", "start_pos", "length"])
_FIXED_ENVELOPE = Obj({"name": _name, "type": Str(enum=("envelope", "envelope_group")), "rows": _pos, "header": _pattern, "footer": _pattern, "is_target": Bool(), "min": Int(0), "max": Int(-1), "columns": Arr(_FIXED_COLUMN), "child_envelopes": Arr(Ref(lambda: _FIXED_ENVELOPE))})
_FIXED2 = Obj({"envelopes": Arr(_FIXED_ENVELOPE)}, ["envelopes"])
_OLD_COLUMN = Obj({"name": _name, "start_pos": _pos, "length": _pos, "line_pattern": _pattern}, ["name", "start_pos", "length"])
_OLD_ENVELOPE = Obj({"name": _name, "by_rows": _pos, "by_header_footer": Obj({"header": _pattern, "footer": _pattern}, ["header", "footer"]), "not_target": Bool(), "columns": Arr(_OLD_COLUMN)})
_FIXED = Obj({"envelopes": Arr(_OLD_ENVELOPE, 1)}, ["envelopes"])
_ELEMENT = Obj({"name": _name, "index": _pos, "component_index": _pos, "empty_if_missing": Bool(), "default": Str()}, ["name", "index"])
_SEGMENT = Obj({"name": _name, "type": Str(enum=("segment", "segment_group")), "is_target": Bool(), "min": Int(0), "max": Int(-1), "elements": Arr(_ELEMENT), "child_segments": Arr(Ref(lambda: _SEGMENT))}, ["name"])
_EDI = Obj({"segment_delimiter": Str(1), "element_delimiter": Str(1), "component_delimiter": Str(1), "repetition_delimiter": Str(1), "release_character": Str(1), "ignore_crlf": Bool(), "segment_declarations": Arr(_SEGMENT)}, ["segment_delimiter", "element_delimiter", "segment_declarations"])
FILE_SHAPES = {"csv": _CSV, "csv2": _CSV2, "fixed-length": _FIXED, "fixedlength2": _FIXED2, "edi": _EDI}
RAW_EDI = Obj({k: v for k, v in _EDI.keys.items() if k != "segment_declarations"}, ["segment_delimiter", "element_delimiter"])

_TYPE = Str(enum=("int", "float", "boolean", "string"))
_COMMON = {"type": _TYPE, "no_trim": Bool(), "keep_empty_or_null": Bool()}
_PATHS = {"xpath": Str(1), "xpath_dynamic": Ref(lambda: _DECL)}
_FUNC = Obj({"name": _name, "args": Arr(Ref(lambda: _DECL)), "ignore_error": Bool()}, ["name"])
_DECL = Obj({**_COMMON, **_PATHS, "const": Str(), "external": Str(1), "custom_func": _FUNC, "custom_parse": Str(1), "template": Str(1), "object": Ref(lambda: _OBJECT), "array": Arr(Ref(lambda: _DECL))})
_OBJECT = Obj({}, open_=True)
KINDS = ("const", "external", "custom_func", "custom_parse", "object", "array", "template")


def _walk(d, path: str, out: list[str], under_array: bool = False) -> None:
    if not isinstance(d, dict):
        return
    kinds = [k for k in KINDS if k in d]
    if len(kinds) > 1:
        out.append(f"{path}: only one of {', '.join(kinds)} can be given")
    if not kinds and "xpath" not in d and "xpath_dynamic" not in d:
        out.append(f"{path}: a declaration needs one of xpath, xpath_dynamic, {', '.join(KINDS)}")
    if ("const" in d or "external" in d) and ("xpath" in d or "xpath_dynamic" in d):
        out.append(f"{path}: const and external take no xpath")
    if "array" in d:
        if under_array:
            out.append(f"{path}: an array can't be directly in an array")
        if "xpath" in d or "xpath_dynamic" in d:
            out.append(f"{path}: an array takes no xpath")
        for i, c in enumerate(d["array"] if isinstance(d["array"], list) else []):
            _walk(c, f"{path}.array[{i}]", out, True)
    if isinstance(d.get("object"), dict):
        for k, c in d["object"].items():
            if k == "_comment":
                continue
            check(c, _DECL, f"{path}.object.{k}", out)
            _walk(c, f"{path}.object.{k}", out)
    if isinstance(d.get("custom_func"), dict):
        for i, c in enumerate(d["custom_func"].get("args", []) or []):
            _walk(c, f"{path}.custom_func.args[{i}]", out)
    if "xpath_dynamic" in d:
        _walk(d["xpath_dynamic"], f"{path}.xpath_dynamic", out)


def _fail(out: list[str], what: str) -> None:
    if len(out) == 1:
        raise SchemaError(f"schema validation failed for {what}: {out[0]}")
    if out:
        raise SchemaError(f"schema validation failed for {what}:\n" + "\n".join(sorted(out)))


def header(schema: dict, any_version: bool = False) -> dict:
    """The checked ``parser_settings``; handlers of their own may have versions of their own."""
    out: list[str] = []
    shape = Obj({"parser_settings": Obj({"version": Str(1), "file_format_type": Str(1), "encoding": Str(enum=ENCODINGS)}, ["version", "file_format_type"])}, ["parser_settings"], open_=True)
    check(schema, shape, "(root)", out)
    _fail(out, "parser_settings")
    settings = schema["parser_settings"]
    if not any_version and not _VERSION.fullmatch(settings["version"]):
        raise SchemaError(f"schema version {settings['version']!r} isn't supported")
    return settings


def transforms(schema: dict) -> dict:
    """The checked ``transform_declarations``."""
    out: list[str] = []
    decls = schema.get("transform_declarations")
    if not isinstance(decls, dict):
        out.append("(root): transform_declarations is required" if decls is None else "transform_declarations: must be an object")
    else:
        if "FINAL_OUTPUT" not in decls:
            out.append("transform_declarations: FINAL_OUTPUT is required")
        for k, d in decls.items():
            if k != "_comment":
                check(d, _DECL, f"transform_declarations.{k}", out)
                _walk(d, f"transform_declarations.{k}", out)
    _fail(out, "transform_declarations")
    return decls


def file_declaration(schema: dict, kind: str) -> dict:
    """The checked ``file_declaration`` of a built-in format that needs one."""
    shape = FILE_SHAPES[kind]
    out: list[str] = []
    check(schema, Obj({"file_declaration": shape}, ["file_declaration"], open_=True), "(root)", out)
    _fail(out, "file_declaration")
    return schema["file_declaration"]
