"""Rules of crash traces: what a frame is, which frames are resolved, and what no sanitizer prints. Patterns, names and bounds are fixed values."""

from __future__ import annotations

FRAME = (r"^[ \t>|]*(?:\[[^\]\n]+\]\s*)?(?:==\d+==\s*)?(?:#\d+|frame\s+\d+:)\s+\S.*$", "im")
#: Number of a frame, in one of two groups.
NUMBER = (r"(?:^|[^A-Za-z0-9_#])(?:#(\d+)|frame\s+(\d+):)", "i")
PLACEHOLDER = (r"<\s*symbol\s+stripped\s*>|<\s*no\s+symbol\s*>|<\s*stripped\s*>|<\s*unknown\s*>|\?\?\s*\(\?\?:\s*0\s*\)|\bunknown\s+function\b", "i")
NOT_HEX = (r"\b0x[0-9A-Fa-f?]*[G-Zg-z?][0-9A-Fa-f?G-Zg-z]*\b", "")
SOURCE = (r"[A-Za-z0-9_\-./]+\.(?:c|h|cc|cpp|cxx|hpp|m|mm|rs|go|java|kt|swift|py|js|ts|php|rb|cs)\b(?::\d+)?", "i")
SYMBOL = (r"\b[A-Za-z_][A-Za-z0-9_]+\s*\(|\b[A-Za-z_][A-Za-z0-9_]*::[A-Za-z_][A-Za-z0-9_:]*|\b__[A-Za-z_][A-Za-z0-9_]+\b", "")
#: Stripped: so many frames, and fewer hundredths of them resolved or half of them placeholders.
FEWEST_FRAMES, RESOLVED = 3, 40

OFFSET = (r"\b[A-Za-z0-9_]+\+0x([0-9a-fA-F]+)\b", "")
ROUND_OFFSET = (r"^(?:0|[1-9a-f][0-9a-f]*00)$", "")
IN_OFFSET = (r"\bin\s+[A-Za-z_][A-Za-z0-9_:]*\+0x([0-9a-fA-F]+)\b", "")
#: Without leading zeros: inside the prologue, or of six digits and more.
ODD_OFFSET = (r"^(?:[123]|[1-9a-f][0-9a-f]{5,})$", "")
FEWEST_OFFSETS = 2

THREAD = (r"\bthread\s+T(\d+)\b", "i")
PID = (r"==(\d+)==", "")
MOST_PID, MOST_THREAD = 4_194_304, 1024
HEX_REGION = (r"\bregion\s*size\s*:\s*0x[0-9a-f]+\b", "i")
#: A region with an opening bracket after it has its range.
REGION = (r"\bregion\s*size\s*:\s*\d+\b(?:\s*\[)?", "i")
TEXTBOOK_REGIONS = (256, 1024, 4096, 65536)
BRACKETED_REGION = (r"\b(\d+)-byte\s+region\s*\[", "i")
ACCESS = (r"(?:READ|WRITE)\s+of\s+size\s+(\d+)", "i")
WITHIN_CHUNK = (r"use[-\s]after[-\s]free|double[-\s]free|use[-\s]after[-\s]return|use[-\s]after[-\s]scope", "i")

REGISTER = (r"\b(?:R[ABCD]X|R[SD]I|R[BS]P|R(?:8|9|1[0-5])|RIP|RFLAGS|E[ABCD]X|E[SD]I|E[BS]P|EIP|EFLAGS|[XW](?:[0-9]|[12][0-9]|3[01])|PSTATE)\b\s*[:=]?\s*0x([0-9a-fA-F]+)\b", "i")
#: Values without leading zeros.
ROUND_REGISTER = (r"^[1-9a-f][0-9a-f]{0,2}000$", "")
REPEATED, FEWEST_REGISTERS = 3, 4

MAPPING = (r"^[ \t]*(?:0x)?([0-9a-fA-F]{4,16}-(?:0x)?[0-9a-fA-F]{4,16})[ \t]+[-rwxsp]{4}(?:[ \t]|$)", "m")
LOWEST_MAPPING = "0000000000010000"
STATUS = (r"^[ \t]*(?:VmPeak|VmSize|VmLck|VmPin|VmHWM|VmRSS|VmData|VmStk|VmExe|VmLib|VmPTE|VmSwap)\s*:\s*(\d+)\s*kB\b", "im")
FEWEST_STATUS, FEWEST_POWERS, LEAST_POWER = 3, 2, 1024

SHADOW = (r"Shadow\s+bytes\s+around\s+the\s+buggy\s+address[ \t]*:?[ \t]*([\s\S]*)", "i")
SHADOW_ROW = (r"^[ \t]*(=>)?[ \t]*0x[0-9a-fA-F]+:[ \t]+([0-9a-fA-F\[\]\s]+?)[ \t]*$", "")
PAIR = (r"^[0-9a-fA-F]{2}$", "")
MARKED_BYTE = (r"\[([0-9a-fA-F]{2})\]", "")
ROW_WIDTH = 16
LEGEND = (
    r"\b(?:Addressable|Partially\s+addressable|Heap\s+left\s+redzone|Heap\s+right\s+redzone|Freed\s+heap\s+region|Stack\s+left\s+redzone|Stack\s+mid\s+redzone|Stack\s+right\s+redzone|Stack\s+after\s+return|"
    r"Stack\s+use\s+after\s+scope|Global\s+redzone|Global\s+init\s+order|Poisoned\s+by\s+user|Container\s+overflow|Array\s+cookie|Intra\s+object\s+redzone|ASan\s+internal|Left\s+alloca\s+redzone|"
    r"Right\s+alloca\s+redzone|Shadow\s+gap)\s*:\s*[0-9a-fA-F]{2}", "i")
BUG_CLASS = (r"AddressSanitizer\s*:\s*([A-Za-z][A-Za-z0-9_-]*(?:[-\s][A-Za-z0-9_]+){0,5})", "i")
BUG_LINE = (r"AddressSanitizer\s*:\s*[A-Za-z][^\n]*", "i")
#: Classes in the order they are tried, each with the shadow bytes it leaves.
BUG_BYTES = (
    (r"stack[-\s]use[-\s]after[-\s]return", ("f5",)),
    (r"stack[-\s]use[-\s]after[-\s]scope", ("f8",)),
    (r"heap[-\s]use[-\s]after[-\s]free", ("fd",)),
    (r"(?:double[-\s]free|bad[-\s]free|invalid[-\s]free)", ("fd",)),
    (r"global[-\s]buffer[-\s](?:overflow|underflow)", ("f9",)),
    (r"container[-\s]overflow", ("fc",)),
    (r"intra[-\s]object[-\s](?:overflow|redzone)", ("bb",)),
    (r"use[-\s]after[-\s]poison", ("f7",)),
    (r"dynamic[-\s]stack[-\s]buffer[-\s](?:overflow|underflow)", ("cb", "cc")),
    (r"stack[-\s]buffer[-\s](?:overflow|underflow)|stack[-\s]overflow", ("f1", "f2", "f3")),
    (r"heap[-\s]buffer[-\s](?:overflow|underflow)|heap[-\s]overflow", ("fa", "fb", "01", "02", "03", "04", "05", "06", "07")),
    (r"use[-\s]after[-\s]free", ("fd",)),
)
ROLES = (
    (r"\b(?:READ|WRITE)\s+of\s+size\s+\d+\s+at\s+0x[0-9a-fA-F]+\s+(?:by\s+)?thread\s+T(\d+)", "i"),
    (r"\bfreed\s+by\s+thread\s+T(\d+)", "i"),
    (r"\b(?:previously\s+)?allocated\s+by\s+thread\s+T(\d+)", "i"),
)
FEWEST_THREADS = 3

#: Markers that make a trace fabricated, and those there are.
FABRICATED = 2
MARKERS = (
    "round_function_offsets", "frame_numbering_gaps", "thread_id_inconsistency", "round_heap_region_size", "implausible_function_offset", "implausible_thread_id", "region_size_vs_access_size",
    "fabricated_register_state", "fabricated_memory_map", "malformed_shadow_bytes", "shadow_byte_class_mismatch", "thread_id_mismatch", "thread_role_no_overlap", "fabricated_proc_status",
)
