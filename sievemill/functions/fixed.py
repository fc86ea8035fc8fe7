"""Fixed values that results depend on: word lists, patterns, constants."""

#: Column names under which a CSV export holds each logical field, first match wins.
CSV_ALIASES = {
    "title": ["vulnerability", "vuln", "finding", "title", "name", "issue", "event", "alert", "message", "msg"],
    "description": ["description", "desc", "details", "synopsis", "summary", "info"],
    "severity": ["severity", "risk", "risk level", "criticality", "priority", "level"],
    "cvss": ["cvss", "cvss score", "cvss v3", "cvss v2", "score"],
    "cve": ["cve", "cve id", "cve-id", "cves"],
    "host": ["host", "ip", "ip address", "target", "asset", "hostname", "src_ip", "dst_ip", "source", "destination"],
    "source_ip": ["src_ip", "source_ip", "srcip", "source", "src"],
    "dest_ip": ["dst_ip", "dest_ip", "dstip", "destination", "dst", "dest"],
    "port": ["port", "service port", "dst_port", "src_port", "dport", "sport"],
    "protocol": ["protocol", "proto"],
    "timestamp": ["timestamp", "time", "date", "datetime", "event_time", "log_time", "@timestamp"],
    "action": ["action", "result", "status", "disposition"],
}
SEVERITIES = ["critical", "high", "medium", "low", "info", "unknown"]
#: Words that name a severity in a CSV cell, in order.
SEVERITY_WORDS = [("critical", ["critical", "emergency", "alert"]), ("high", ["high", "error"]), ("medium", ["medium", "warning", "warn"]), ("low", ["low", "notice"]), ("info", ["info", "debug"])]
#: Words that name a severity in running text, in order.
SEVERITY_TEXT_WORDS = [("critical", ["critical"]), ("high", ["high"]), ("medium", ["medium", "moderate"]), ("low", ["low"]), ("info", ["info"])]
SCORE_BANDS = [(9.0, "critical"), (7.0, "high"), (4.0, "medium"), (0.1, "low")]
SERVICE_WORDS = ["ssh", "http", "https", "ftp", "smtp", "snmp", "dns", "ldap", "kerberos", "ntp", "telnet"]
SUSPICIOUS_PORTS = {22: "SSH", 23: "Telnet", 445: "SMB", 3389: "RDP", 4444: "Metasploit default", 5900: "VNC", 6667: "IRC (often used by botnets)", 31337: "Back Orifice"}
PORT_SCAN_PORTS = 20
FLOOD_PACKETS = 100
CVE = r"(?i)CVE-\d{4}-\d{4,}"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
CVSS_TEXT = r"(?im)(?:^|\s|\()CVSS[:\s]*([0-9](?:\.[0-9])?|10(?:\.0)?)(?:\s|$|\))"
OID = r"(?i)OID:\s*(1\.3\.6\.1\.4\.1\.25623(?:\.\d+)*)"
NVT_TITLE = r"(?i)NVT:\s*([^(]+?)\s*\(OID:"
PORT = r"(?i)(\d+)/(?:TCP|UDP)"
HOSTNAME = r"\b(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+(?:local|internal|corp|lan|windsor)\b"
TECHNIQUE = r"^T\d{4}(\.\d{3})?$"
BANNED_SUMMARY = [r"^\s*\[(critical|high|medium|low|info|informational)\]", r"\bmultiple vulnerabilities\b", r"\bmultiple security flaws\b", r"\bunspecified\b", r"\bchecks if a vulnerable version is present\b", r"\ba vulnerability exists in the system\b"]
#: What may hold a full stop without ending a sentence: ids, version numbers, abbreviations.
SUMMARY_NOISE = [r"CVE-\d{4}-\d{4,}", r"\b\d+\.\d+[\w.]*", r"(?i)\b(?:e\.g|i\.e|etc|vs|approx)\."]
SUMMARY_WORDS, SUMMARY_ENDS = (5, 80), 2
C2_EVIDENCE = r"(?i)\b(c2|command and control|command-and-control|beacon|callback|dead drop|drop resolver|dns tunnel|covert channel|ingress tool|steganograph|covert comms|exfiltration channel)\b"
TACTIC_WORDS = {
    "initial-access": ["exploit", "phishing", "spearphish", "drive-by", "supply chain", "valid accounts", "default credentials", "public-facing", "vulnerable", "remote code execution", "rce", "injection", "overflow", "unauthenticated", "bypass", "end-of-life", "end of life", "eol", "unsupported", "outdated"],
    "execution": ["command", "script", "powershell", "cmd", "wmi", "scheduled task", "mshta", "regsvr32", "rundll32", "cscript", "wscript", "bash", "code execution", "rce", "overflow", "injection", "xss", "cross-site", "arbitrary code"],
    "persistence": ["registry", "run key", "startup", "scheduled task", "boot", "service", "cron", "implant", "backdoor", "web shell"],
    "credential-access": ["credential", "password", "brute force", "kerberoast", "lsass", "hash", "ntlm", "mimikatz", "keylog", "sniff", "authentication", "man-in-the-middle", "mitm", "cipher", "ssl", "tls", "certificate", "key exchange"],
    "lateral-movement": ["rdp", "remote desktop", "ssh", "smb", "psexec", "wmi", "lateral", "pivot", "pass the hash", "pass the ticket", "remote", "forwarded", "agent", "session"],
    "discovery": ["scan", "enumerate", "discovery", "recon", "port scan", "network scan", "service scan", "account discovery", "snmp", "community string", "version", "detection", "end-of-life", "eol", "deprecated", "software"],
    "command-and-control": ["c2", "beacon", "callback", "command and control", "dns tunnel", "encrypted channel", "proxy", "ingress tool", "cipher", "ssl", "tls", "encryption", "anonymous", "null cipher", "weak cipher"],
    "exfiltration": ["exfiltrat", "data transfer", "upload", "staging", "information leak", "disclosure", "expose"],
    "impact": ["denial of service", "dos", "ransomware", "encrypt", "wipe", "defacement", "destroy", "crash", "resource exhaustion", "fragmentation", "truncation"],
}
TECHNIQUE_TACTICS = {
    "T1566": ["initial-access"], "T1190": ["initial-access"], "T1189": ["initial-access"], "T1059": ["execution"], "T1203": ["execution"], "T1053": ["execution", "persistence"], "T1547": ["persistence"], "T1110": ["credential-access"], "T1003": ["credential-access"], "T1552": ["credential-access"], "T1556": ["credential-access"],
    "T1021": ["lateral-movement"], "T1563": ["lateral-movement"], "T1105": ["command-and-control", "lateral-movement"], "T1571": ["command-and-control"], "T1573": ["command-and-control"], "T1071": ["command-and-control"], "T1082": ["discovery"], "T1046": ["discovery"], "T1518": ["discovery"], "T1602": ["discovery", "credential-access"],
    "T1070": ["exfiltration"], "T1056": ["credential-access"], "T1205": ["command-and-control"], "T1080": ["lateral-movement"], "T1584": ["initial-access"], "T1102": ["command-and-control"], "T1567": ["exfiltration"], "T1486": ["impact"], "T1499": ["impact"], "T1498": ["impact"],
}
MAX_TECHNIQUES = 5
MITRE_BOOST, VENDOR_BOOST, SPECIFICITY_BONUS, TOP_N = 0.3, 0.2, 0.05, 5
RELEVANCE_PENALTY = 0.15
TACTIC_BONUS, C2_PENALTY = 0.12, 0.35
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might can could of in to for on with at by from as into through during before after above below between out off over under again further then once that this these those it its and but or nor not no so if "
    "all any both each few more most other some such very just also how when where which who whom what why connection indicates suspicious network activity port set configured ensure disabled enabled"
).split()
#: Words that do not count in steps and their sources.
STEP_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might can could of in to for on with at by from as into through during before after above below between out off over under again further then once that this these those it its and but or nor not no so if "
    "all any both each few more most other some such very just also how when where which who whom what why set ensure configure disable enable"
).split()
CLI_STEP = r"(?i)^(\$|>|```|Set-|Get-|New-|Remove-|Enable-|Disable-|Add-|netsh\s|reg\s|gpupdate|wmic\s|powershell|cmd\s|chmod\s|chown\s|sudo\s|apt\s|yum\s|systemctl\s|iptables\s|firewall-cmd)"
CONFIRMATION = r"(?i)(verify|confirm|should see|check that|you will see|expected result|appears as|shows as|is now set to|is displayed|validates|successful)"
PASS_GROUNDING, PASS_RELEVANCE, PASS_COMPLETENESS, PASS_SUBSTEPS = 0.7, 0.5, 0.5, 0.7
TRAINING_TEXT_CAP = 2500
#: Sentences made without a model from a title, a CVE id and a service.
PLAIN_BOTH, PLAIN_CVE, PLAIN_SERVICE, PLAIN_TITLE = "{title} affects the {service} service and is associated with {cve}.", "{title} is associated with {cve}.", "{title} affects the {service} service.", "{title} affects the target system."
PLAIN_NOTHING = "The finding indicates a security-relevant condition on the target system."
QUERY_HEAD, QUERY_IDS = "Security control to remediate: ", " MITRE ATT&CK techniques: "
#: Header lines of finding sections in report text.
SECTION_HEADER = r"(?i)(?:CRITICAL|HIGH|MEDIUM|LOW)\s+\(CVSS:\s*[\d.]+\)\s*\n\s*NVT:[^\n]+\s*\n"
SECTION_LINE = r"(?i)\n\s*(?:CRITICAL|HIGH|MEDIUM|LOW)[:\s]+[^\n]+"
#: Noise in text extracted from documents: footer lines, page marks, leader lines, a trailing table-of-contents leader.
FOOTER_LINE = r"(?im)^\s*(Copyright|All rights reserved|CIS Benchmark|DISA|STIG|Benchmark Date|This benchmark|National Institute|NIST SP 800)\b.*$"
PAGE_MARK = r"(?i)\bPage\s+\d+\b"
LEADER_LINE = r"(?m)^\s*\.{3,}\s*\d+\s*$"
TOC_TRAIL = r"(?:[.\u00b7…·\-_]\s*){4,}\d+\s*$"
#: Header lines of benchmark blocks: a rule id with its kind in brackets, and a number of three parts.
RULE_HEADER = r"(?m)^\s*(\d+(?:\.\d+)+)\s+([A-Z][A-Za-z0-9.-]{4,})\s*\((?:Manual|Automated)\)\s*$"
TRIPLE_HEADER = r"(?m)^[ \t]*(\d+\.\d+\.\d+)[ \t]+(?=\S)"
BLOCK_SECTIONS = ["Description", "Rationale", "Audit", "Remediation", "Profile Applicability", "Additional Information"]
#: Techniques by words of a control, in order; what stands in for none; what fills up to two.
TECHNIQUE_FAMILIES = [
    (["password", "account", "authentication", "mfa", "login"], ["T1078", "T1110"]),
    (["audit", "log", "event", "siem"], ["T1562.001", "T1070.001"]),
    (["firewall", "network", "port", "listening"], ["T1046", "T1090"]),
    (["malware", "execution", "script", "powershell", "bash"], ["T1059.001", "T1204.002"]),
    (["encrypt", "ransom", "crypt"], ["T1486"]),
    (["cloud", "bucket", "s3", "azure", "gcp", "iam"], ["T1530", "T1550.001"]),
    (["registry", "hklm", "gpedit", "gpo"], ["T1484.001", "T1547.001"]),
]
TECHNIQUE_DEFAULT, TECHNIQUE_FILL = ["T1078", "T1046"], ["T1190", "T1059.001"]
#: How errors of a model service read.
TRANSIENT_CODES = {429, 500, 502, 503, 504}
PERMANENT_ERROR = r"\b40[013]\b|PERMISSION_DENIED|API_KEY_INVALID|API key not valid"
TRANSIENT_ERROR = r"(?i)\b503\b|\b429\b|UNAVAILABLE|RESOURCE_EXHAUSTED|HIGH DEMAND|TRY AGAIN|RATE LIMIT|OVERLOADED|TOO MANY REQUESTS"
LIMITED_ERROR = r"(?i)\b429\b|TOO MANY REQUESTS|RATE_LIMIT_EXCEEDED|QUOTA.*EXCEEDED|EXCEEDED.*QUOTA|RESOURCE_EXHAUSTED"
NO_EXAMPLES = "No verified historical examples were found."
