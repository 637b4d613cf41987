"""Fixed values of the record format and the text outputs."""

# Event id masks and qualifier bits.
EVENTID_MASK = 0xFFFFFFFC
START_BIT = 1
END_BIT = 2

# Event ids with a meaning of their own.
VFS_LOOKUP = 0x03010090
SYSCALL_EXIT = 0x040C0004
THREAD_TERMINATE = 0x040C05A4
NEW_THREAD_DATA = 0x07000004
NEW_THREAD_NAME = 0x07010004
EXEC_NAME = 0x07010008
LOST_EVENTS = 0x07020008
INFO_STRING = 0x07020010
SCHEDULED = 0x01400000
STACK_HANDOFF = 0x01400008
MAKE_RUNNABLE = 0x01400018
WAIT_REASON_CODE = 0x00400040
WAKE_REASON_CODE = 0x00400108
TRACE_CLASS = 7
TRACE_INFO_SUBCLASS = 2
MACH_CLASSES = (1, 50)

# Raw file layout.
RAW_MAGIC = 0x55AA0101
RAW_PAGE = 4096
CPU_IS_COPROCESSOR = 1

# Command length, path words and the tail shown of a path.
COMMAND_LENGTH = 16
PATH_WORDS = 23
PATH_TAIL = 51

# Fixed value: frames a program's backtrace holds at most.
USER_FRAMES = 32

# What ends a symbol in a debugger line, and the name where there is none.
OFFSET_MARK = "+"
QUEUE_MARK = ", queue ="
NO_SYMBOL = "UNKNOWN_SYM"

# Message id flag bits.
MIG_BIT = 60
FROM_KERNEL_BIT = 58

# Wake-up kinds.
WAKEUP_KINDS = {1: "WAKEUP_ALL", 2: "WAKEUP_ONE", 3: "WAKEUP_THR", 4: "CLEAR_WAIT"}

# Event classes.
CLASS_NAMES = {
    1: "MACH",
    2: "NETWORK",
    3: "FSYSTEM",
    4: "BSD",
    5: "IOKIT",
    6: "DRIVERS",
    7: "TRACE",
    8: "DLIL",
    9: "WORKQUEUE",
    10: "CORESTORAGE",
    11: "CG",
    20: "MISC",
    30: "SECURITY",
    31: "DYLD",
    32: "QT",
    33: "APPS",
    34: "LAUNCHD",
    37: "PERF",
    38: "IMPORTANCE",
    40: "BANK",
    41: "XPC",
    42: "ATM",
    43: "ARIADNE",
    44: "DAEMON",
    45: "ENERGYTRACE",
    50: "MACH",
    255: "MIG",
}

# Colours by group id modulo 13.
PALETTE = [
    "blue",
    "aquamarine",
    "burlywood",
    "cadetblue",
    "cornflowerblue",
    "darkgrey",
    "darkgreen",
    "darkorange",
    "mediumpurple",
    "gold",
    "forestgreen",
    "sienna",
    "yellowgreen",
]

# Message log arrows and thresholds.
NORMAL_ARROW = "-[#red]>"
SLOW_ARROW = "-[#0000FF]>"
SLOW_DELAY = 10000
SHORT_GAP = 100
LABEL_DIVISOR = 10000

# Page and part sizes.
PAGE_LINES = 64
PART_ROWS = 40000
WRAP_MARKER = "Begin the next line"

# Page heading of the report.
PAGE_GAP = "Number of microsecs since in last page %8.1f"
PAGE_COLUMNS = (
    "   AbsTime(Us)      Delta            debugid                       arg1             arg2             arg3             "
    "arg4              thread         cpu#  command"
)
