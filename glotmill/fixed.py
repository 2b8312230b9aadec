"""Values that are fixed by the formats and the rules that this engine serves."""

# Worksheet codes that are never translated.
SAFE_CODES = ("CT", "DCS", "GGD", "GCS", "HMI", "KYN", "MCC", "MNS", "PLC", "PT", "VFD")

# Reason codes for leaving a picture's text unchanged.
RETAIN_CODES = (
    "photo_exempt_site", "photo_exempt_building", "photo_exempt_equipment",
    "photo_exempt_people", "photo_exempt_crowd", "photo_exempt_scene",
    "already_target", "no_text", "logo_only",
)
UNREADABLE_CODE = "unreadable_text"

# Stages of a job in order.
STAGES = ("preflight", "inspect", "prepare", "translate", "validate", "apply", "verify", "office-validate", "deliver")

# Patterns of protected tokens. "plain" has no look-around, so any regular expression engine takes it.
_UNITS = r"(?:%|°C|℃|kW|MW|V|kV|A|mA|Pa|kPa|MPa|mm|cm|m|km|kg|t|t/h|m[³3]/h|Nm[³3]/min|rpm|r/min)"
_URLS = r"https?://\S+|www\.\S+"
_CODES = r"\b[A-Z][A-Z0-9._/-]*\d[A-Z0-9._/-]*\b"
TOKEN_PATTERNS = {
    "shared": rf"{_URLS}|(?<![\w.])\d+(?:[.,]\d+)?\s*{_UNITS}(?![A-Za-z0-9])|{_CODES}",
    "word": rf"{_URLS}|\b\d+(?:[.,]\d+)?\s*{_UNITS}(?![A-Za-z0-9])|{_CODES}",
    "plain": r"https?://[^ \t\n]+|www\.[^ \t\n]+|[0-9]+(?:[.,][0-9]+)? ?(?:kW|MW|kV|mA|kPa|MPa|rpm)|[A-Z][A-Z0-9._/-]*[0-9][A-Z0-9._/-]*",
}

# Formats by file extension, and whether a conversion comes first.
ROUTES = ((".docx", "word", False), (".doc", "word", True), (".xlsx", "excel", False), (".xls", "excel", True), (".pptx", "ppt", False), (".ppt", "ppt", True))

# Unit names and the symbols that they stand for.
UNIT_NAMES = {"吨/日": "t/d", "吨/天": "t/d", "吨/小时": "t/h", "千瓦": "kW", "毫米": "mm", "厘米": "cm", "千克": "kg", "公斤": "kg", "吨": "t"}

# Patterns of quantities with a unit, of standards' numbers, of units that stand alone, and of plain numbers.
QUANTITY = (
    r"(?<![\w.])\d+(?:[.,]\d+)?\s*(?:[mMk]?W|[mMk]?Pa|[kM]?V|mA|A|[kcm]?m|kg|t|kcal|mg|Nm|%|°C|Hz|rpm|r/min)"
    r"(?:[23])?(?:\s*/\s*(?:[kcm]?m[23]?|kg|h|d|min|s))?(?![A-Za-z0-9])"
)
STANDARD = r"\b(?:ISO|IEC|EN|DIN|ASTM|ASME|ANSI|BS|GB)\s*[-/]?\s*[A-Z]*\d[\w:./-]*"
BARE_UNIT = r"(?<![A-Za-z])(?:Nm|kN|N|mm|cm|km|m|kg|mg|kW|MW|W|kPa|MPa|Pa|kV|V|mA|A|Hz|rpm|min|t|h|s)(?![A-Za-z])"
NUMBER = r"-\d+(?:[.,]\d+)?(?=\s*°C)|[+±]\d+(?:[.,]\d+)?|(?<![\w.])-\d+(?:[.,]\d+)?|(?<![\d.])\d+(?:[.,]\d+)?"
URL = r"https?://\S+|www\.\S+"
CODE = r"\b[A-Z][A-Z0-9._/-]*\d[A-Z0-9._/-]*\b"
LENGTH = r"\d+(?:\.\d+)?\s*(?:[kcm]?m|Nm)"
ROMAN = r"[ivxlcdm]+[.)]?"
HAN = "[㐀-鿿]"

# Spellings that count as one, in order.
SPELLINGS = (
    (r"(?i)\b(Annexure|Appendix|Attachment)-(?=\d)", "$1 "),
    (r"(?i)\b(to|from|at|of|voltage)(?=\d+(?:[.,]\d+)?\s*[kM]?V(?![A-Za-z0-9]))", "$1 "),
    *((r"(?<=\d)\s*" + name, symbol) for name, symbol in UNIT_NAMES.items()),
    (r"(?i)/\s*days?\b", "/d"),
    (r"(?i)/\s*hours?\b", "/h"),
    (r"(?<=\d),(?=\d{3}(?:\D|$))", ""),
    (r"(?<=\d)\s*Kv\b", " kV"),
)
DEFAULT_REASON = "Reviewed: source is appropriate in the target document"

# Patterns of a parameter (label, separator, value), of its value, and of what is never translated.
PARAMETER = r"^\s*([^：:\n]{1,16})([：:])\s*([^\n]+?)\s*$"
PARAMETER_VALUE = r"^(?:[+-]?\d|[A-Z]{1,8}\d)"
SAFE_DIMENSION = r"^(?i)(?:\d+(?:[.,]\d+)?\s*[*×x]\s*){1,3}\d+(?:[.,]\d+)?(?:\s*(?:mm|cm|m))?$"
SAFE_LETTER = r"^[A-Z]$"
SAFE_IDENTIFIER = r"^(?=[A-Za-z0-9./_-]*\d)[A-Za-z0-9][A-Za-z0-9./_-]*$"

# Functions whose result depends on which rows or how many cells there are.
POSITIONAL = (
    "ROW", "ROWS", "COLUMN", "COLUMNS", "OFFSET", "INDIRECT", "ADDRESS", "CELL",
    "COUNTA", "COUNTBLANK", "COUNTIF", "COUNTIFS", "SUMIF", "SUMIFS", "AVERAGEIF",
    "AVERAGEIFS", "SUMPRODUCT", "INDEX", "MATCH", "XMATCH", "XLOOKUP", "VLOOKUP",
    "HLOOKUP", "FILTER", "SORT", "UNIQUE", "SEQUENCE", "TEXTJOIN", "CONCAT", "CONCATENATE",
)

# Labels with a translation of their own.
LABELS = {
    "版次": "Revision", "审核": "Reviewed by", "校对": "Checked by", "编制": "Prepared by", "工程名称": "Project Name", "设计号": "Design No.",
    "设计阶段": "Design Stage", "初步设计": "Preliminary Design", "专业": "Discipline", "工艺": "Process", "子项名称": "Subproject Name",
    "子项号": "Subproject No.", "图号": "Drawing No.", "日期": "Date", "序 号": "Item No.", "名称 型号 规格": "Name / Model / Specification",
    "单位": "Unit", "数量": "Quantity", "单重(千克)": "Unit Weight (kg)", "总重(千克)": "Total Weight (kg)", "功率(KW)": "Power (kW)", "功率(kW)": "Power (kW)",
    "耗气量(Nm3/min)": "Air Consumption (Nm3/min)", "耗水量 (m3/h)": "Water Consumption (m3/h)", "设备来源": "Equipment Source", "备注": "Remarks",
    "台": "unit", "套": "set", "型号": "Model", "额定功率": "Rated Power", "额定电压": "Rated Voltage", "额定转速": "Rated Speed",
    "调速范围": "Speed Control Range", "防护等级": "Protection Rating", "冷却方式": "Cooling Method", "材质": "Material", "风量": "Air Flow",
    "全压": "Total Pressure", "转速": "Speed", "斜度": "Slope", "速比": "Gear Ratio", "功率": "Power", "合计": "Total",
}
