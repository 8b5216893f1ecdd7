"""Keys restated over strings."""

import re


def host(s):
    return s.strip().casefold()


def title(s):
    text = " ".join(s.split()).casefold()
    if text in ("", "unknown stig", "nessus compliance"):
        return ""
    bare = text.removesuffix(".audit").replace("security technical implementation guide", " ")
    words = [w for w in re.split("[^a-z0-9]+", bare) if w and w not in ("stig", "scap", "benchmark", "manual", "disa") and not re.fullmatch(r"v\d+r\d+", w)]
    return " ".join(words) or text


def stem(s):
    return re.sub(r"r\d+_rule$", "", re.sub(r"^xccdf_[^_]+_rule_", "", s.strip()))
