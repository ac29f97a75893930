"""Kinds of objects from path and leading bytes.  Pure CASE expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bytes as B
from .numeric import flag

# Magic numbers, vocabularies, suffix and keyword lists.
DEX, ELF, ZIP, ZIP_EMPTY = b"dex\n", b"\x7fELF", b"PK\x03\x04", b"PK\x05\x06"
GZIP, PNG, JPG, ARSC, AXML = b"\x1f\x8b", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"\x02\x00\x0c\x00", b"\x03\x00\x08\x00"
DEX_VERSIONS = [b"dex\n035\x00", b"dex\n036\x00", b"dex\n037\x00", b"dex\n038\x00", b"dex\n039\x00"]
ENTRY_TYPES = ["dex", "elf", "manifest", "arsc", "archive", "asset", "unknown"]
SECTION_TYPES = [
    "dex_header", "dex_string_ids", "dex_type_ids", "dex_proto_ids", "dex_field_ids", "dex_method_ids", "dex_class_defs",
    "dex_code_item", "dex_string_data", "dex_other", "elf_text", "elf_rodata", "elf_data", "elf_dynamic", "elf_dynsym",
    "elf_init_array", "elf_custom", "elf_other", "window", "whole_entry",
]
MAGIC_TYPES = ["dex", "elf", "zip", "png", "jpg", "gif", "gzip", "axml", "arsc", "unknown"]
PATH_TYPES = [
    "classes_dex", "secondary_dex", "native_lib", "assets", "res_raw", "res_other", "meta_inf", "resources_arsc", "manifest",
    "embedded_archive", "root_file", "unknown",
]
MODEL_SUFFIXES = [
    ".bin", ".dat", ".db", ".sqlite", ".sqlite3", ".tflite", ".onnx", ".pb", ".pt", ".mp4", ".mp3", ".ogg", ".wav", ".jpg",
    ".jpeg", ".png", ".webp",
]
FAMILY_KINDS = {
    "xor": "encrypted_dex", "base64": "encrypted_dex", "split_xor": "encrypted_dex", "dex_string_encrypted": "encrypted_dex",
    "dex_method_inlined": "extracted_method_body", "embedded_asset": "compressed_payload",
    "embedded_archive": "compressed_payload", "so_embedded": "native_stub", "multi_dex_shim": "shim",
    "path_randomized": "shim", "signature_strip": "shim",
}
LOADER_KEYWORDS = {
    "dex_class_loader": ["DexClassLoader"], "path_class_loader": ["PathClassLoader"], "load_dex": ["loadDex", "openDexFile"],
    "load_library": ["loadLibrary"], "reflection": ["reflect", "Method.invoke"],
}
NATIVE_KEYWORDS = {
    "jni_onload": ["JNI_OnLoad"], "dlopen": ["dlopen"], "dlsym": ["dlsym"], "mmap": ["mmap"], "mprotect": ["mprotect"],
    "system_property": ["__system_property"],
}
SECTION_KEYWORDS = {"packed": [".packed"], "jiagu": [".jiagu"], "bangcle": [".bangcle"], "ijiami": [".ijiami"]}
PATH_KEYWORDS = ["payload", "encrypt", "protect", "jiagu", "shell"]


def first_match(rules: Sequence[tuple[Column, str]], default: Column | str) -> Column:
    """First rule whose condition holds."""
    out = F.when(*rules[0])
    for cond, value in rules[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


def clean_path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Extension with its dot from the lower-cased base name, '' without one."""
    return F.regexp_extract(base_name(path), r"(\.[^./]+)$", 1)


def path_suffix(path: Column) -> Column:
    """Like ``suffix``, but a base name that is all extension (``.dex``) has none."""
    return F.regexp_extract(base_name(path), r".(\.[^./]+)$", 1)


def is_zip(data: Column) -> Column:
    return B.starts_with_bytes(data, ZIP) | B.starts_with_bytes(data, ZIP_EMPTY)


def object_type(path: Column, data: Column) -> Column:
    p = clean_path(path)
    s = path_suffix(p)
    return first_match(
        [
            (s == ".dex", "dex"),
            ((s == ".so") | p.startswith("lib/"), "native_lib"),
            (p.startswith("meta-inf/"), "signature"),
            (is_zip(data) | s.isin(".apk", ".jar", ".zip"), "embedded_archive"),
            (p.startswith("assets/"), "asset_blob"),
            (p.startswith("res/") | (p == "resources.arsc"), "resource"),
        ],
        "unknown_blob",
    )


def entry_type(path: Column, data: Column) -> Column:
    """Magic bytes decide first, the path second."""
    p = clean_path(path)
    b = base_name(p)
    axml = (F.length(data) >= 8) & B.starts_with_bytes(data, AXML)
    by_magic = [
        (B.starts_with_bytes(data, DEX), "dex"),
        (B.starts_with_bytes(data, ELF), "elf"),
        (is_zip(data), "archive"),
        (B.starts_with_bytes(data, ARSC), "arsc"),
        ((F.length(data) >= 4) & B.starts_with_bytes(data, GZIP), "archive"),
        (axml & (p == "androidmanifest.xml"), "manifest"),
        (axml, "asset"),
    ]
    by_path = [
        (p == "androidmanifest.xml", "manifest"),
        (p == "resources.arsc", "arsc"),
        (b.startswith("classes") & b.endswith(".dex"), "dex"),
        (p.startswith("lib/") | b.endswith(".so"), "elf"),
        (b.rlike(r"\.(apk|jar|zip|dex)$"), "archive"),
        (p.startswith("assets/") | p.startswith("res/") | p.startswith("meta-inf/"), "asset"),
    ]
    return first_match(by_magic + by_path, "unknown")


def magic_type(data: Column) -> Column:
    at = lambda m: B.starts_with_bytes(data, m)
    return first_match(
        [
            (F.length(data) < 4, "unknown"),
            (at(DEX), "dex"),
            (at(ELF), "elf"),
            (is_zip(data), "zip"),
            (at(PNG), "png"),
            (at(JPG), "jpg"),
            (at(b"GIF87a") | at(b"GIF89a"), "gif"),
            (at(GZIP), "gzip"),
            (at(AXML[:3]), "axml"),
            ((F.length(data) > 4) & at(ARSC), "arsc"),
        ],
        "unknown",
    )


def one_hot(value: Column, vocabulary: Sequence[str]) -> Column:
    return F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.when(v == value, 1.0).otherwise(0.0))


def path_type(path: Column) -> Column:
    p = clean_path(path)
    return first_match(
        [
            (p == "classes.dex", "classes_dex"),
            (p.startswith("classes") & p.endswith(".dex"), "secondary_dex"),
            (p.startswith("lib/") | p.endswith(".so"), "native_lib"),
            (p.startswith("assets/"), "assets"),
            (p.startswith("res/raw/"), "res_raw"),
            (p.startswith("res/"), "res_other"),
            (p.startswith("meta-inf/"), "meta_inf"),
            (p == "resources.arsc", "resources_arsc"),
            (p == "androidmanifest.xml", "manifest"),
            (p.rlike(r"\.(apk|jar|zip)$"), "embedded_archive"),
            (~p.contains("/"), "root_file"),
        ],
        "unknown",
    )


def path_bucket(path: Column, coarse: Column) -> Column:
    """Reporting bucket of a path, falling back to the coarse entry type."""
    p = clean_path(path)
    b = base_name(p)
    s = F.when(b.contains("."), F.concat(F.lit("."), F.substring_index(b, ".", -1))).otherwise("")
    return first_match(
        [
            (b == "classes.dex", "classes.dex"),
            (b.startswith("classes") & b.endswith(".dex"), "secondary_dex"),
            (p.startswith("lib/") | b.endswith(".so"), "lib_so"),
            (b == "resources.arsc", "resources_arsc"),
            (p == "androidmanifest.xml", "manifest"),
            (p.startswith("meta-inf/"), "meta_inf"),
            ((coarse == "archive") | s.isin(".apk", ".jar", ".zip", ".gz"), "nested_archive"),
            (p.startswith("res/raw/"), "res_raw"),
            (p.startswith("res/"), "res_other"),
            (p.startswith("assets/") & s.isin(*MODEL_SUFFIXES), "model_data_file"),
            (p.startswith("assets/"), "assets"),
            (coarse == "asset", "asset_entry"),
            (coarse == "unknown", "unknown_blob"),
        ],
        coarse,
    )


def instance_kind_at_inference(path: Column) -> Column:
    """Routing from the path alone; takes no label on purpose."""
    p = F.lower(path)
    return first_match(
        [
            (p.endswith(".dex") | p.contains("classes"), "encrypted_dex"),
            (p.endswith(".so") | p.contains("/lib/"), "native_stub"),
            (p.contains("assets/"), "compressed_payload"),
            (p.contains("meta-inf/") | p.contains("manifest") | p.endswith(".arsc"), "metadata_table"),
        ],
        "shim",
    )


def instance_kind_for_training(
    path: Column, label_id: Column, families: Column, kinds: Mapping[str, str] = FAMILY_KINDS
) -> Column:
    """Known family of a positive first, then benign, then the path."""
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    known = F.filter(F.transform(families, lambda f: F.try_element_at(table, f)), lambda k: k.isNotNull())
    mapped = F.when((label_id > 0) & (F.size(known) > 0), F.try_element_at(known, F.lit(1)))
    benign = F.when(label_id == 0, F.lit("benign_other"))
    return F.coalesce(mapped, benign, instance_kind_at_inference(path))


def magic_scan(data: Column, limit: int = 256) -> dict[str, Column]:
    """Magic numbers anywhere in the leading ``limit`` bytes (the feature is about headers)."""
    head = F.substring(data, 1, limit)
    dex = B.contains_bytes(head, DEX_VERSIONS[0])
    for m in DEX_VERSIONS[1:]:
        dex = dex | B.contains_bytes(head, m)
    return {
        "has_dex_magic": flag(dex),
        "has_elf_magic": flag(B.contains_bytes(head, ELF)),
        "has_png_magic": flag(B.contains_bytes(head, PNG)),
        "has_zip_local_header": flag(B.contains_bytes(head, ZIP)),
    }


def header_flags(path: Column, data: Column) -> dict[str, Column]:
    """Eight plausibility flags of a dex-like header."""
    n = F.length(data)
    size, map_off, ids_off = (B.uint32_le(data, o) for o in (32, 52, 60))
    versions = [bytearray(m) for m in DEX_VERSIONS]
    near = B.contains_bytes(F.substring(data, 1, 512), ZIP) | (
        (n > 512) & B.contains_bytes(F.substring(data, F.greatest(n - 511, F.lit(1)), F.lit(512)), ZIP)
    )
    return {
        "dex_magic_present": flag((n >= 8) & F.substring(data, 1, 8).isin(*versions)),
        "file_size_plausible": flag((n >= 112) & size.between(1024, 100 * 1024 * 1024) & (size <= n)),
        "map_list_offset_plausible": flag((n >= 116) & (map_off >= 112) & (map_off < n) & (map_off % 4 == 0)),
        "string_ids_offset_aligned": flag((n >= 108) & (ids_off % 4 == 0)),
        "nearby_zip_local_header": flag(near),
        "object_path_is_dex_like": flag(path.rlike(r"(?i)\.dex$") | path.rlike(r"(?i)classes\d*\.dex")),
        "object_path_is_asset": flag(F.lower(path).startswith("assets/")),
        "object_path_is_lib_so": flag(path.rlike(r"^lib/[^/]+/.*\.so$")),
    }


def keyword_flags(data: Column, keywords: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    out = {}
    for name, words in keywords.items():
        hit = B.contains_bytes(data, words[0].encode())
        for w in words[1:]:
            hit = hit | B.contains_bytes(data, w.encode())
        out[name] = flag(hit)
    return out


def path_keyword_flag(path: Column) -> Column:
    return flag(F.lower(path).rlike("|".join(PATH_KEYWORDS)))


def path_parts(path: Column) -> dict[str, Column]:
    """Normalised path, base name, extension, depth."""
    p = clean_path(path)
    return {
        "norm_path": p,
        "base_name": base_name(p),
        "extension": F.regexp_extract(p, r"(\.[^./]+)$", 1),
        "depth": (F.length(p) - F.length(F.translate(p, "/", ""))).cast("int"),
    }
