"""Fixed values that results depend on: codes, names, prefixes and patterns."""

from __future__ import annotations

# fixed values: event classes
EXEC, FILE_R, FILE_W, NET_CON, NET_LIS, FORK, CLONE, SETUID, MMAP, PTRACE, PRCTL, OTHER = 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15

# fixed values: label and resource type of every class
LABELS = {0: "execve", 1: "openat(R)", 2: "openat(W)", 3: "connect", 4: "listen", 5: "fork", 6: "clone", 7: "setuid", 8: "mmap", 9: "ptrace", 10: "syscall", 15: "syscall"}
RTYPES = {0: "EXEC", 1: "FILE", 2: "FILE", 3: "NET", 4: "NET", 5: "EXEC", 6: "EXEC", 7: "SYS", 8: "MEM", 9: "MEM", 10: "UNK", 15: "UNK"}
CLASSES = tuple(LABELS)

# fixed values: names of ordinary daemons and tools, and of servers that shouldn't call out
DAEMONS = (
    "nginx", "sshd", "apache2", "httpd", "mysqld", "postgres", "postgresql",
    "redis-server", "mongod", "memcached", "systemd", "init", "cron", "rsyslogd",
    "dockerd", "containerd", "kubelet", "java", "python3", "python", "ruby",
    "node", "php", "php-fpm", "bash", "sh", "dash", "zsh", "fish", "sudo",
    "su", "ssh", "curl", "wget", "cat", "ls", "find", "grep", "awk", "sed",
    "apt", "dpkg", "yum", "dnf", "pip", "git", "tar", "gzip", "bzip2",
    "openssl", "strace", "tcpdump", "which", "env", "id", "whoami", "ps",
    "top", "netstat", "ss", "ip", "ifconfig", "route", "hostname", "uname",
)
SERVERS = ("nginx", "sshd", "apache2", "httpd", "mysqld", "postgres", "postgresql", "redis-server", "bash", "sh", "dash", "zsh", "python", "python3")

# fixed values: resources
SENSITIVE_PREFIXES = ("/etc/shadow", "/etc/passwd", "/etc/sudoers", "/root/", "/proc/", "/sys/", "/dev/mem", "/.ssh/", "/tmp/", ".aws/credentials", "id_rsa", "ssl/private")
HARD_TRIGGERS = ("/etc/shadow", "/etc/sudoers", "/.ssh/id_rsa", "/.ssh/id_ed25519", "/.ssh/authorized_keys", ".aws/credentials", "ssl/private", "/var/backups/shadow", "/proc/self/mem", "/dev/mem")
STAGED_EXEC_PREFIXES = ("/tmp/", "/var/log/", "/home/admin/cache")
PAM_COMMS = ("sshd", "pam", "login", "passwd", "su", "sudo", "polkit", "chpasswd", "newgrp", "gpasswd")

# fixed values: address ranges that aren't routable, as first address and prefix length
RESERVED_RANGES = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)

# fixed values: meaning of an event; the first rule whose class and (lower-cased) resource part fit
# (resource parts, classes, label, techniques, risk, benign)
SEMANTIC_RULES = (
    (("/etc/shadow",), (1,), "credential access: system password database", ("T1003",), "CRITICAL", False),
    (("/etc/passwd",), (1,), "account enumeration: user database read", ("T1003", "T1087"), "HIGH", False),
    (("/etc/sudoers",), (1, 2), "privilege config: sudo rules accessed", ("T1003", "T1068"), "CRITICAL", False),
    (("/.ssh/id_rsa", "/.ssh/id_ed25519", "/.ssh/id_ecdsa"), (1,), "credential access: SSH private key read", ("T1003", "T1552"), "CRITICAL", False),
    ((".aws/credentials", ".aws/config"), (1,), "credential access: AWS access keys", ("T1003", "T1552"), "CRITICAL", False),
    (("ssl/private", "server.key", ".pem"), (1,), "credential access: TLS private key", ("T1003", "T1552"), "CRITICAL", False),
    (("/tmp/", "/dev/shm/", "/var/tmp/"), (0,), "execution from temp: possible staged payload", ("T1059", "T1105"), "HIGH", False),
    (("/.hidden/", "/.x", "/.cache/"), (0,), "execution from hidden path: evasion attempt", ("T1059", "T1564"), "HIGH", False),
    ((), (9,), "process injection: ptrace attach", ("T1055",), "HIGH", False),
    (("prot_exec", "prot_write"), (8,), "memory injection: RWX page allocation", ("T1055", "T1620"), "HIGH", False),
    ((), (7,), "privilege escalation: setuid call", ("T1068",), "HIGH", False),
    (("/var/log/auth.log", "/var/log/secure", "/var/log/syslog"), (2,), "log tampering: security log overwrite", ("T1562", "T1070"), "HIGH", False),
    (("/etc/cron.d/", "/etc/crontab", "/etc/rc.local"), (2,), "persistence: cron/init script modification", ("T1562", "T1053"), "HIGH", False),
    ((":4444", ":4443", ":1337", ":31337", ":8888", ":9999", ":6666"), (3,), "outbound to unusual port: probable C2 beacon", ("T1071", "T1095"), "HIGH", False),
    (("185.", "91.", "45.142", "194.165"), (3,), "outbound to known-suspicious IP range", ("T1071",), "MEDIUM", False),
    (("192.168.", "10.0.", "172.16."), (3,), "internal lateral: RFC-1918 outbound connection", ("T1021", "T1210"), "MEDIUM", False),
    (("/tmp/", "/dev/shm/"), (2,), "data staging: write to temp directory", ("T1074",), "MEDIUM", False),
    (("/var/www/html/", "/srv/www/"), (1,), "web-root read: normal web server file serving", (), "LOW", True),
    (("/var/log/nginx/", "/var/log/apache2/"), (2,), "web server log write: normal operation", (), "LOW", True),
    (("deb.debian.org", "archive.ubuntu.com", "pypi.org", "registry.npmjs.org"), (3,), "package manager connection: normal update operation", (), "LOW", True),
    (("/var/lib/postgresql/", "/var/lib/mysql/"), (1, 2), "database I/O: normal database engine operation", (), "LOW", True),
    (("/proc/self/", "/proc/sys/"), (1,), "self-inspection: normal process status read", (), "LOW", True),
    ((":80", ":443", ":8080"), (4,), "standard web server port: normal bind", (), "LOW", True),
    ((":22",), (4,), "SSH server port: normal sshd bind", (), "LOW", True),
    ((":5432", ":3306", ":6379"), (4,), "database server port: normal loopback bind", (), "LOW", True),
)

# fixed values: class that a word in a claim hints at, in order
CLAIM_CLASSES = (
    ("openat(r)", 1), ("openat(w)", 2), ("read", 1), ("open", 1), ("connect", 3), ("listen", 4), ("execve", 0),
    ("exec", 0), ("ptrace", 9), ("setuid", 7), ("mmap", 8), ("fork", 5), ("clone", 6),
)
CLAIM_WORDS = ("reads", "read", "writes", "write", "executes", "exec", "connects", "connect", "access", "from", "to")

# fixed values: text signals of the heuristic classifier
HEURISTIC = {
    "credential": ("/etc/shadow", "/etc/passwd", "/.ssh/", ".aws/credentials", "id_rsa", "ssl/private", "sensitive: true"),
    "staged": ("/tmp/", "/dev/shm", ".hidden"),
    "c2": (":4444", ":4443", ":1337", ":8888", ":9999", ":31337", "185.", "93.184", "104."),
    "logs": ("/var/log/", "auth.log", "cron.d", "crontab"),
    "daemons": ("nginx", "postgres", "sshd", "apache", "systemd"),
    "undaemonlike": ("/tmp/", "setuid", "ptrace", "sensitive: true", ":4444"),
    "packages": ("apt", "dpkg", "yum", "pip"),
}

# fixed values: window rules (name, technique, score, resource parts, classes); parts and classes may come from different events
WINDOW_RULES = (
    ("shadow_read", "T1003", 0.90, ("/etc/shadow",), (1,)),
    ("key_read", "T1003", 0.85, ("/.ssh/id_rsa", "/.ssh/id_ed25519", ".aws/credentials", "ssl/private"), ()),
    ("setuid", "T1068", 0.88, (), (7,)),
    ("ptrace", "T1055", 0.92, (), (9,)),
    ("exec_tmp", "T1059", 0.75, ("/tmp/", "/dev/shm/", "/.hidden"), (0,)),
    ("log_wipe", "T1562", 0.70, ("/var/log/auth.log", "/var/log/syslog", "/var/log/secure"), (2,)),
    ("cron_write", "T1562", 0.72, ("/etc/cron.d/", "/etc/crontab", "/etc/sudoers"), (2,)),
    ("c2_port", "T1071", 0.78, (":4444", ":4443", ":1337", ":31337", ":8888", ":9999"), (3,)),
)
EXFILTRATION, LATERAL = 0.82, 0.65
EXFILTRATED = ("/etc/shadow", "/.ssh/id_rsa", ".aws/credentials", "ssl/private", "/etc/passwd")
BENIGN_MARKERS = ("nginx", "apache2", "sshd", "systemd", "postgres", "/var/www/", "/var/lib/postgresql/", "deb.debian.org")

# fixed values: event signatures
SSH_KEYS = ("/.ssh/id_rsa", "/.ssh/id_ed25519", "/.ssh/id_ecdsa", "/.ssh/authorized_keys")
C2_HOSTS = ("185.220.101.1", "185.220.101.2", "93.184.216.34", "10.0.0.100")
C2_PORTS = ("4444", "1337", "31337")

# fixed values: resources that mark a provenance event as known bad
MALWARE_PATHS = ("/tmp/vUgefal", "/var/log/devc", "/home/admin/cache", "/var/log/xtmp", "libdrakon.freebsd.x64.so", "libdrakon.linux.x64.so", "drakon.freebsd.x64", "drakon.linux.x64", "loaderDrakon")

# fixed values: provenance event types and system call names
PROVENANCE_TYPES = {
    "EVENT_READ": 1, "EVENT_WRITE": 2, "EVENT_OPEN": 1, "EVENT_CREATE_OBJECT": 2, "EVENT_EXECUTE": 0, "EVENT_FORK": 5, "EVENT_CLONE": 6,
    "EVENT_CONNECT": 3, "EVENT_SENDTO": 3, "EVENT_SENDMSG": 3, "EVENT_ACCEPT": 4, "EVENT_RECVFROM": 3, "EVENT_RECVMSG": 3, "EVENT_MMAP": 8,
    "EVENT_MPROTECT": 8, "EVENT_CHANGE_PRINCIPAL": 7, "EVENT_MODIFY_PROCESS": 15, "EVENT_UNLINK": 2, "EVENT_RENAME": 2, "EVENT_TRUNCATE": 2, "EVENT_CHMOD": 15,
}
STRACE_CALLS = {"execve": 0, "openat": 1, "open": 1, "connect": 3, "listen": 4, "fork": 5, "clone": 6, "mmap": 8, "ptrace": 9, "setuid": 7}
CALL_NUMBERS = {
    59: 0, 322: 0, 0: 1, 17: 1, 19: 1, 1: 2, 18: 2, 20: 2, 42: 3, 44: 3, 49: 4, 50: 4, 57: 5, 56: 5, 58: 5, 105: 7, 117: 7, 9: 8, 10: 8, 101: 9, 157: 10,
}
CALL_RESOURCES = {0: "[exec]", 1: "[file_read]", 2: "[file_write]", 3: "[net_connect]", 4: "[net_listen]", 5: "[fork]", 7: "[setuid]", 8: "[mmap]", 9: "[ptrace]", 10: "[prctl]", 15: "[other]"}
ATTACK_TECHNIQUES = {"adduser": "T1136", "hydra_ftp": "T1110", "hydra_ssh": "T1110", "java_meterpreter": "T1055", "meterpreter": "T1055", "webshell": "T1505", "c100": "T1059"}

RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SEVERITY = {"CRITICAL": 0.95, "HIGH": 0.85, "MEDIUM": 0.65}
TIERS = ("LOG_ONLY", "PAUSE", "KILL", "QUARANTINE", "ISOLATE")
