"""Results equal the reference's only with exactly these."""

# Programs skipped, with their flags, at the head of a command.
WRAPPERS = ["sudo", "env", "nohup", "time", "command", "exec", "builtin", "doas", "setsid", "stdbuf", "nice", "ionice", "unbuffer"]

# Tokens between commands.
SEPARATORS = [";", "|", "||", "&&", "&"]

# Programs whose here-documents are code.
INTERPRETERS = ["bash", "sh", "dash", "zsh", "ksh", "python", "python3", "python2", "perl", "ruby", "php", "node"]

# Extensions a program's name loses, one at most.
EXTENSIONS = ["exe", "com", "bat", "cmd", "ps1"]

# Names of event fields as events carry them, found whatever their case.
EVENT_FIELDS = [
    "EventID", "Image", "CommandLine", "OriginalFileName", "CurrentDirectory", "User", "IntegrityLevel", "Hashes", "Company", "Description", "Product", "FileVersion",
    "ParentImage", "ParentCommandLine", "ParentUser", "ParentProcessId", "ProcessId", "LogonId", "TerminalSessionId",
    "DestinationIp", "DestinationPort", "DestinationHostname", "TargetFilename", "TargetObject", "EventType",
]

# Fields that only audit records have; a rule that names one, or a0, a1, ..., is read against records.
AUDIT_FIELDS = ["type", "comm", "exe", "key", "name", "nametype", "SYSCALL", "argc"]

# Dash forms that a windash value stands for.
DASHES = ["-", "/", "–", "—", "―"]

# Event classes and the rule categories they answer to.
CLASS_CATEGORY = {"network": "network_connection", "file": "file_event", "registry": "registry_set"}

# Rule products by platform.
PRODUCT = {"linux-auditd": "linux", "windows-sysmon": "windows", "macos-es": "macos"}

# Detections shown on a finding; titles shown of firing rules; causes shown of a histogram.
MOST_RULES, MOST_FIRING, MOST_CAUSES = 5, 3, 5

# Classes of described telemetry: the first whose pattern is in the lower-cased line.
TELEMETRY_CLASSES = [
    ("process_access", ["process access", "eid 10", "sekurlsa", "readprocessmemory", "lsass memory", "memory of lsass", "handle to lsass", "minidump", "ptrace()", "pid 1 namespaces"]),
    ("log_clear", ["1102", "log cleared", "log erase", "audit log", "wevtutil", "clear-eventlog", "clears the", "vacuum", "audit rule", "history to /dev/null", "history logging disabled"]),
    ("registry_set", ["registry", "eid 13", "run key", "asep"]),
    ("image_load", ["image load", "eid 7", "eid 6", "driver load", "kernel module", "kextload", "kext load", "insmod", "modprobe", " lkm", "dll load", "init_module"]),
    ("scheduled_task", ["scheduled task", "4698", "schtasks", "cron", "launchd job", "periodic script", " at job", "atrun", "enabling a timer"]),
    ("service_change", ["service install", "7045", "sc.exe create", "systemd", "launchdaemon", "launchctl", "4697", "new service"]),
    ("ps_script", ["scriptblock", "4104", "amsi", "script block"]),
    ("authentication", ["logon", "4624", "4720", "4732", "4625", "account created", "member added", "4768", "4769", "4662", "4776", "kerberos", "tgs-req", "as-req", "ds-replication", "drsuapi", "auth event"]),
    ("permission_change", ["chmod", "setmode", "setflags", "chattr", "chflags", "immutable", "setextattr", "quarantine", "execute bit", "host capabilities"]),
    ("network_connection", ["connect", "eid 3", "socket", "bind", "listen", "outbound", "netlink", "tcp/", "networkextension", "pf log", "network connection", "remote host", "remote ip", "reverse shell", "ldap", "dns quer", "proxy chain", "tunnel", "bits-client", "netfilter", "samr"]),
    ("file_write", ["write()", "create()", "eid 11", "file create", "notify_write", "notify_create", "written", "truncate", "unlink", "writes to", "overwrit", "write to /sys", "rc.local", "utime"]),
    ("file_access", ["openat", "notify_open", "esf open", "read by", "reads", " read()", "read of", "open of", "opens ", "access to", "getxattr", "cpassword"]),
    ("process_creation", ["execve", "eid 1", "4688", "notify_exec", "process creation", "process create", "esf exec", "shell process", "spawn", "memory-only", "child process", "interpreter", "processrollup", "wmi", "wsmprovhost", "ntdsutil", "vssadmin", "suid"]),
]
