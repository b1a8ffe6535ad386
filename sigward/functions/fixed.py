"""Fixed values that results depend on: word lists, patterns, limits and texts."""

# Directories never scanned.
EXCLUDED_DIRS = ["/opt/yara/rules", "/opt/yara/backup", "/opt/yara/reports"]

# Base-name globs never scanned.
EXCLUDED_NAMES = [
    "daily_scan_alert_*.html",
    "yara_scan_*.html",
    "test_*.html",
    "*.yar",
    "*.yara",
    "agentid_row.txt",
]

# Tokens of other platforms.
PLATFORM_TOKENS = ["Windows", "PE", "MZ", "win32", "win64"]

# Deny list for rule files.
DENIED_PREFIX = "Android_"
DENIED_GENERIC = ["domain.yar", "base64.yar", "url.yar", "base64_gz.yar"]
DENIED_INDEX = ["packers_index.yar", "maldocs_index.yar", "index_w_mobile.yar"]
BAD_INCLUDE = 'include "./'

# Rule categories and their patterns, in report order.
CATEGORIES = [
    ("TROJAN", "Linux_Trojan"),
    ("EXPLOIT", "Linux_Exploit"),
    ("CRYPTOMINER", "Linux_Cryptominer"),
    ("RANSOMWARE", "Linux_Ransomware"),
    ("ROOTKIT", "Linux_Rootkit"),
    ("BACKDOOR", "Linux_Backdoor"),
    ("WEBSHELL", "Linux_Webshell"),
    ("HACKTOOL", "Linux_Hacktool"),
    ("XZ_BACKDOOR", "CVE.2024.3094|XZ.*[Bb]ackdoor|xz_util"),
    ("PWNKIT", "CVE.2021.4034|PwnKit|pkexec"),
    ("MIRAI", "[Mm]irai"),
    ("SSH_ATTACK", "SSH|ssh.*brute|ssh.*backdoor"),
]

# Categories of the one-line summary, in order, with their labels.
SUMMARY_LABELS = [
    ("TROJAN", "Trojan"),
    ("EXPLOIT", "Exploit"),
    ("CRYPTOMINER", "Cryptominer"),
    ("RANSOMWARE", "Ransomware"),
    ("MIRAI", "Mirai"),
    ("XZ_BACKDOOR", "XZ-backdoor"),
]

# Feeds recognised by file-name prefix (case kept) or substring (case ignored).
FEED_PREFIXES = [("Elastic", "Linux_"), ("APT", "APT_")]
FEED_WORDS = [
    ("Ransomware", "ransom"),
    ("Trojan", "trojan"),
    ("Exploit", "exploit"),
    ("Backdoor", "backdoor"),
    ("Webshell", "webshell"),
    ("Malware", "malware"),
]

# Phrases that mark a change event in the agent log.
CHANGE_WORDS = ["Integrity checksum changed", "New file added", "modified", "deleted"]

# Content markers and the names they stand for, tested in order.
CONTENT_MARKERS = [
    ("STANDARD-ANTIVIRUS-TEST-FILE", "EICAR Test"),
    ("MALWARE_TEST_STRING", "Test Malware"),
]

# Display names, exact rule names first, then globs.
DISPLAY_NAMES = [
    ("without_attachments", "Missing Attachments"),
    ("without_images", "Missing Images"),
    ("without_urls", "Missing URLs"),
    ("with_urls", "Contains URLs"),
    ("Bolonyokte", "Bolonyokte Malware"),
    ("Misc_Suspicious_Strings", "Suspicious Strings"),
    ("powershell", "PowerShell Code"),
    ("EzcobStrings", "Ezcob Strings"),
    ("Ezcob", "Ezcob Malware"),
    ("Cerberus", "Cerberus Malware"),
    ("IronTiger_ASPXSpy", "IronTiger ASPXSpy"),
    ("IP", "IP Address Pattern"),
]
DISPLAY_GLOBS = [
    ("EICAR*", "EICAR Test Virus"),
    ("SUSP*EICAR*", "Suspected EICAR"),
    ("Multi_EICAR*", "Multiple EICAR"),
]

# Friendly names of the base rules.
FRIENDLY_NAMES = [
    ("Test_Malware", "Test Malware"),
    ("EICAR_Test_File", "EICAR Test"),
    ("Webshell_Generic", "Webshell"),
    ("Suspicious_Base64_Shell", "Base64 Shell"),
]

# Threat descriptions by word in the rule name; the first that fits is taken.
THREAT_DESCRIPTIONS = [
    (
        "Log_Cleaner",
        "Malware designed to hide traces by deleting or modifying system logs. Often used after compromise to evade"
        " detection.",
    ),
    (
        "Trojan",
        "Malicious software disguised as legitimate program. Can provide backdoor access, steal data, or download"
        " additional malware.",
    ),
    (
        "Cryptominer",
        "Cryptocurrency mining malware that uses system resources to mine digital currency without authorization.",
    ),
    (
        "Ransomware",
        "Malware that encrypts files and demands payment for decryption. Can cause severe data loss and operational"
        " disruption.",
    ),
    (
        "Exploit",
        "Code that takes advantage of software vulnerabilities to gain unauthorized access or execute malicious"
        " commands.",
    ),
    (
        "Backdoor",
        "Hidden method of bypassing authentication to gain remote access. Allows persistent unauthorized system"
        " control.",
    ),
    (
        "Rootkit",
        "Advanced malware that hides its presence and maintains privileged access while evading detection mechanisms.",
    ),
    (
        "Webshell",
        "Script uploaded to web server providing remote command execution. Often used for persistent web application"
        " compromise.",
    ),
    (
        "XZ",
        "CVE-2024-3094: Critical backdoor in XZ Utils allowing remote code execution. Affects SSH authentication"
        " chain.",
    ),
    (
        "Mirai",
        "IoT botnet malware that enslaves devices for DDoS attacks. Self-propagating through weak credentials.",
    ),
    (
        "SSH",
        "SSH-related attack tool or bruteforcer. Attempts unauthorized access through SSH protocol exploitation.",
    ),
    (
        "PwnKit",
        "CVE-2021-4034: Local privilege escalation vulnerability in PolicyKit. Allows any user to gain root"
        " privileges.",
    ),
]
DEFAULT_DESCRIPTION = (
    "Suspicious file matching YARA detection rules. Further analysis recommended to determine exact threat nature."
)

# Actions by severity.
SEVERITY_ACTIONS = [
    ("critical", ["quarantine", "kill", "block", "mail"]),
    ("high", ["quarantine", "alert"]),
    ("medium", ["alert", "log"]),
    ("low", ["log"]),
]

# Alert line, its decoder and the level of a decoded threat.
ALERT_LINE = "%s YARA: Threat detected - %s - File: %s - Quarantined: %s"
ALERT_PREFIX = "YARA:"
ALERT_PATTERN = r"Threat detected - (\S+) - File: (\S+)"
ALERT_PHRASE = "Threat detected"
ALERT_LEVEL = 12
ALERT_GROUP = "malware"

# Watched components and limits of the watchdog.
COMPONENTS = ["agentd", "execd", "logcollector", "modulesd", "syscheckd"]
MAX_MEMORY_MB = 3500
MAX_PROCESSES = 100
MAX_RESTARTS = 2
RESTART_WINDOW_SEC = 3600
ALERT_GAP_SEC = 3600

# Threat-count thresholds, retention days and the expected release.
WARNING_ABOVE = 5
CRITICAL_ABOVE = 10
EXPIRE_DAYS = 30
COMPRESS_DAYS = 7
EXPECTED_VERSION = "13.7"
EXPECTED_SCRIPTS_ABOVE = 10

# Recommendation texts by metric.
ADVICE_CPU = "High CPU usage detected. Consider reviewing active processes and optimizing YARA scan schedules."
ADVICE_DISK = "Disk usage is high. Consider cleaning old logs or increasing disk space."
ADVICE_DETECTIONS = "Review quarantined files and investigate infection vectors."
ADVICE_CHANGES = "High number of file changes detected. Review FIM alerts for unusual activity."
ADVICE_ALWAYS = [
    "Continue monitoring system health and security events.",
    "Review detailed daily reports for trend analysis.",
]

# Advice of the status report, given when its score is below 80.
STATUS_GOOD = 80
STATUS_ENGINE = "Install or fix YARA engine"
STATUS_AGENT = "Start agent service"
STATUS_RULES = "Download YARA rules"
STATUS_CPU = "High CPU usage - review active processes"
STATUS_DISK = "Low disk space - clean up logs or expand storage"

# The base rules every corpus starts with: name, condition, strings by id.
BASE_RULES = [
    (
        "EICAR_Test_File",
        "$eicar",
        [("$eicar", "X5O!P%@AP[4\\PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*")],
    ),
    (
        "Suspicious_Base64_Shell",
        "any of them",
        [
            ("$a", "eval(base64_decode"),
            ("$b", "base64_decode(shell_exec"),
            ("$c", "system(base64_decode"),
        ],
    ),
    (
        "Webshell_Generic",
        "2 of them",
        [
            ("$a", "shell_exec("),
            ("$b", "system("),
            ("$c", "passthru("),
            ("$d", "exec("),
            ("$e", "popen("),
        ],
    ),
]
