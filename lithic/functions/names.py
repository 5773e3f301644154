"""Predicates and constructors of names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words whose meaning the results depend on.
GENERIC_PREFIXES = ("r", "t", "arg", "var", "val", "tmp", "obj", "str", "num")
GENERIC_WORDS = ("_", "__", "$$", "e", "a", "b", "c", "i", "j", "k", "n", "x", "y", "z", "tmp", "temp")
POSITION_WORDS = ("first", "second", "third", "fourth", "last")
RESERVED_WORDS = (
    "default", "this", "super", "class", "extends", "const", "let", "var", "function", "return", "if", "else", "for", "while", "do",
    "switch", "case", "break", "continue", "throw", "try", "catch", "finally", "new", "delete", "typeof", "void", "in", "instanceof",
    "of", "true", "false", "null", "undefined", "NaN", "Infinity", "async", "await", "yield", "import", "export", "from", "as", "with",
    "debugger", "enum", "implements", "interface", "package", "private", "protected", "public", "static",
)
#: Words that cannot be identifiers.
JS_RESERVED = (
    "break", "case", "catch", "continue", "debugger", "default", "delete", "do", "else", "finally", "for", "function", "if", "in", "instanceof",
    "new", "return", "switch", "this", "throw", "try", "typeof", "var", "void", "while", "with", "class", "const", "enum", "export", "extends",
    "import", "super", "implements", "interface", "let", "package", "private", "protected", "public", "static", "yield", "null", "true", "false",
    "undefined", "NaN", "Infinity", "arguments", "eval",
)
#: What no module is named after: prefixes and whole names.
MODULE_PREFIXES = (
    "tmp", "closure_", "fnResult", "arg", "module_", "_interopRequire", "_interopDefault", "_interopNamespace", "_module", "_exports", "_require",
    "_global", "_dependencyMap", "_importDefault", "_importAll",
)
MODULE_NAMES = (
    "default", "_default", "undefined", "null", "true", "false", "item", "self", "key", "value", "merged", "exports", "wrapper", "require",
    "anonymous", "global", "__esModule", "module", "dependencyMap", "__INTERNAL_VIEW_CONFIG", "_module", "_exports", "_require", "_global",
    "_dependencyMap", "importDefault", "importAll", "_importDefault", "_importAll", "Object", "Object2", "Object3", "Array", "Array2", "Array3",
    "num", "str", "val", "res", "items", "keys", "values", "entries", "result", "results", "prototype", "call", "apply", "toString", "arr", "obj",
    "fn", "clear", "store", "callback", "set",
)
CALLBACK_ROLES = ("item", "index", "acc", "a", "b", "result", "match_", "offset")
ACTION_VERBS = (
    "get", "set", "is", "has", "use", "add", "on", "create", "make", "fetch", "load", "save", "read", "write", "parse", "format", "handle",
    "remove", "delete", "clear", "reset", "update", "init", "build", "check", "ensure", "with", "to", "from", "can", "should", "will", "did",
)
ROLE_BASES = ("obj", "arr", "items", "item", "set", "list", "map", "fn", "num", "str", "val", "bool", "res", "el")
GENERIC_PATH_PARTS = ("js", "ts", "src", "lib", "packages", "node_modules", "native", "ios", "android", "web")
AGENT_NOUNS = {"encode": "encoder", "decode": "decoder", "serialize": "serializer", "deserialize": "deserializer", "tokenize": "tokenizer", "normalize": "normalizer", "sanitize": "sanitizer"}


def is_reserved(name: Column) -> Column:
    return name.isin(*JS_RESERVED)


def is_valid_identifier(name: Column) -> Column:
    return name.rlike(r"^[\p{L}\p{Nl}_$][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}_$]*$")


def is_generic_param(name: Column) -> Column:
    """True where a name carries no meaning for a parameter."""
    numbered = name.rlike(rf"^({'|'.join(GENERIC_PREFIXES)})[0-9]*$")
    placeholder = name.startswith("closure_") | name.startswith("outer")
    return placeholder | numbered | name.isin(*GENERIC_WORDS, *POSITION_WORDS, *RESERVED_WORDS)


def is_callback_role(name: Column) -> Column:
    return name.isin(*CALLBACK_ROLES)


def begins_with_verb(name: Column) -> Column:
    return name.rlike(rf"^({'|'.join(ACTION_VERBS)})[A-Z]")


def is_role_with_digits(name: Column) -> Column:
    return name.rlike(rf"^({'|'.join(ROLE_BASES)})[0-9]*$")


def is_generic_module(name: Column) -> Column:
    """Not one token, a common word, role or prefix of generated names, or a result's name; a number at the end does not matter."""
    bare = F.regexp_replace(name, "[0-9]+$", "")
    listed = name.isin(*MODULE_NAMES) | bare.isin(*MODULE_NAMES)
    return name.rlike(r"\s") | listed | name.rlike(f"^({'|'.join(MODULE_PREFIXES)})") | is_role_with_digits(name) | bare.endswith("Result")


def semantic_identifier(prop: Column) -> Column:
    """Digits become vN, reserved words get a leading underscore, what is no identifier is null."""
    return (
        F.when(prop.rlike("^[0-9]+$"), F.concat(F.lit("v"), prop))
        .when(is_valid_identifier(prop), F.when(is_reserved(prop), F.concat(F.lit("_"), prop)).otherwise(prop))
    )


def sanitized_identifier(name: Column) -> Column:
    clean = F.regexp_replace(name, r"[^\p{L}\p{Nd}_$]", "_")
    return F.when((clean == "") | clean.rlike(r"^[0-9]") | is_reserved(clean), F.concat(F.lit("_"), clean)).otherwise(clean)


def import_name(module: Column) -> Column:
    """The last part of a module path in camel case; null if too short or reserved."""
    last = F.regexp_extract(module, "[^/]*$", 0)
    words = F.filter(F.split(F.regexp_replace(last, r"[^A-Za-z0-9_$\-. ]", ""), r"[\-. ]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w, k: F.when(k == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))), "")
    clean = F.when(joined.rlike("^[0-9]"), F.concat(F.lit("_"), joined)).otherwise(joined)
    return F.when((F.length(clean) > 1) & ~is_reserved(clean), clean)


def constant_name(shown: Column) -> Column:
    """The identifier that a constant's text is, without its quotes; null for other texts, long ones and common globals."""
    # Names that say nothing about a constant.
    common = ("undefined", "null", "true", "false", "default", "exports", "module", "require", "global", "Object", "Array", "Function", "String", "Number", "Boolean", "Symbol", "Error", "Math", "JSON", "console", "window", "document", "this")
    bare = F.regexp_replace(F.regexp_replace(F.trim(shown), '^"+|"+$', ""), "^'+|'+$", "")
    return F.when(bare.rlike("^[A-Za-z_$][A-Za-z0-9_$]*$") & (F.length(bare) <= 40) & ~bare.isin(*common), bare)


def agent_noun(method: Column) -> Column:
    pairs = [F.lit(x) for kv in AGENT_NOUNS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), method)


def argument_index(name: Column) -> Column:
    """arg3 or p3 -> 3, else null."""
    digits = F.regexp_extract(name, "^(?:arg|p)([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("int"))


def path_stem(path: Column) -> Column:
    """The file's name without extension and platform suffix; of an index file, its folder's name."""
    bare = F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), r"\.(tsx|ts|jsx|js)$", "")
    bare = F.regexp_replace(bare, r"\.(android|native|ios|web)$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.when((last == "index") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(last)


def slot_key(level: Column, slot: Column) -> Column:
    return F.shiftleft(level.cast("long"), 24).bitwiseOR(slot.cast("long"))


def placeholder_slot(name: Column) -> tuple[Column, Column]:
    """closure_L_S -> (L, S); closure_N -> (0, N); else nulls."""
    two, one = F.regexp_extract(name, "^closure_([0-9]+)_([0-9]+)$", 1), F.regexp_extract(name, "^closure_([0-9]+)$", 1)
    level = F.when(two != "", two.cast("int")).when(one != "", F.lit(0))
    slot = F.when(two != "", F.regexp_extract(name, "^closure_([0-9]+)_([0-9]+)$", 2).cast("int")).when(one != "", one.cast("int"))
    return level, slot
