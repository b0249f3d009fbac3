"""Fixed values of the value rules: dictionaries, word lists, patterns and formats.

They must equal the source rules for equal results and are kept as data that a
user may replace; the order of dictionaries and patterns is part of the rules.
"""

# Full body names and their abbreviations.
AGENCY_NAMES = {
    "Environment and Climate Change Canada": "ECCC",
    "Fisheries and Oceans Canada": "DFO",
    "Indigenous Services Canada": "ISC",
    "Transport Canada": "TC",
    "Health Canada": "HC",
    "Natural Resources Canada": "NRCAN",
    "Parks Canada": "PC",
    "Impact Assessment Agency of Canada": "IAAC",
    "Energy, Mines and Low Carbon Innovation": "EMLI",
    "Ministry of Energy Mines and Low Carbon Innovation": "EMLI",
    "Ministry of Energy, Mines and Low Carbon Innovation": "EMLI",
    "Environmental Assessment Office": "EAO",
    "Ministry of Environment and Climate Change Strategy": "ENV",
    "Ministry of Forests, Lands, Natural Resource Operations and Rural Development": "FOR",
    "Ministry of Agriculture": "AGRI",
    "Ministry of Transportation and Infrastructure": "MOTI",
    "British Columbia Oil and Gas Commission": "BCOGC",
    "BC Oil and Gas Commission": "BCOGC",
    "Example First Nation A": "EFNA",
    "Example First Nation B": "EFNB",
    "Example National Government C": "ENGC",
    "Example Band D": "EBD",
    "First Nations Health Authority": "FNHA",
    "First Nations": "FN",
    "Fraser Basin Council": "FBC",
    "Canadian Environmental Assessment Agency": "CEAA",
}
# Words that initials leave out.
ACRONYM_SKIP = ("of", "and", "the", "for", "in", "on", "at")

# Comment types by substring, in order.
COMMENT_TYPES = {
    "information requirement": "Information Requirement",
    "info req": "Information Requirement",
    "information request": "Information Requirement",
    "ir": "Information Requirement",
    "general observation": "General Observation",
    "general comment": "General Comment",
    "comment": "General Comment",
    "clarification": "Clarification",
    "recommendation": "Recommendation",
    "concern": "Concern",
    "question": "Question",
    "follow-up": "Follow-up",
    "technical comment": "Technical Comment",
    "editorial": "Editorial",
}
# Statuses by substring, in order.
STATUSES = {
    "open": "Open",
    "pending": "Open",
    "active": "Open",
    "in progress": "In Progress",
    "ongoing": "In Progress",
    "under review": "In Progress",
    "closed": "Closed",
    "resolved": "Closed",
    "complete": "Closed",
    "completed": "Closed",
    "satisfied": "Closed",
    "addressed": "Closed",
}
# Round numbers in lower-case text, first match counts.
ROUND_PATTERNS = (r"round\s*(\d+)", r"r(\d+)", r"phase\s*(\d+)", r"p(\d+)", r"screening\s*r?(\d+)", r"review\s*(\d+)", r"\b(\d+)\b")
# Agency codes at the start of an identifier, first match counts.
ID_PATTERNS = (r"^([A-Z]+)-(.+)$", r"^([A-Z]+)\.([A-Z]+.*)$", r"^([A-Z]+)_(.+)$", r"^([A-Z]+)\s+(.+)$", r"^([A-Z]{2,})(\d+)$")
# Titles removed from the front of an author, once each in this order.
AUTHOR_TITLES = ("Mr.", "Ms.", "Dr.", "Prof.")

# Header words by kind, in order; the kinds themselves are the header indicators.
HEADER_WORDS = {
    "id": ("id", "identifier", "comment id", "comment_id", "ref", "reference", "number", "no", "#", "item"),
    "comment": ("comment", "comments", "text", "description", "content", "detail", "observation", "requirement", "request"),
    "response": ("response", "reply", "answer", "proponent response", "proponent reply", "company response", "resolution"),
    "author": ("author", "reviewer", "source", "from", "submitted by", "name", "source author", "reviewer name"),
    "date_received": ("date received", "received", "date", "submission date", "submit date", "received date", "date submitted"),
    "date_responded": ("date responded", "response date", "reply date", "date sent", "response sent", "date response sent"),
    "status": ("status", "state", "condition", "resolution status", "comment status"),
    "section": ("section", "chapter", "part", "reference section", "document section"),
    "topic": ("topic", "subject", "theme", "category", "topic label", "subject area"),
    "round": ("round", "phase", "review round", "review phase", "screening round"),
    "type": ("type", "comment type", "category", "classification", "kind"),
    "agency": ("agency", "organization", "dept", "department", "ministry", "reviewer agency", "source agency"),
}
# The description that a header's kind gives.
DESCRIPTIONS = {
    "id": "Unique identifier for the record",
    "comment": "Text content of the comment or feedback",
    "response": "Reply or answer to the comment",
    "author": "Person or entity who created the content",
    "date_received": "Date when the item was created or received",
    "date_responded": "Date when response was sent",
    "status": "Current state or condition of the item",
    "section": "Document section or part being referenced",
    "topic": "Subject matter or theme of the comment",
    "round": "Review round or phase number",
    "type": "Category or classification of the item",
    "agency": "Organization or department involved",
}
# Headers mapped without a model.
FALLBACK_HEADERS = {
    "ID": "comment_id", "Comment ID": "comment_id", "Comment": "comment_text", "Comments": "comment_text", "Response": "response_text",
    "Proponent Response": "response_text", "Author": "author", "Source Author": "author", "Reviewer": "author", "Date Received": "date_received",
    "Date": "date_received", "Date Response Sent": "date_responded", "Response Date": "date_responded", "Status": "status", "Comment Status": "status",
    "Section": "section", "Reference Section": "section", "Topic": "topic", "Subject": "topic", "Round": "round", "Phase": "round",
    "Review Round": "round", "Type": "comment_type", "Comment Type": "comment_type", "Agency": "agency", "Reviewer Agency": "agency",
}
# Sheet names, header search limits, sample length.
SKIP_SHEETS = ("summary", "metadata", "legend", "cover", "readme")
PREFER_SHEETS = ("comment", "data", "main", "table", "itt")
LAST_HEADER_ROW, LEAST_INDICATORS, LEAST_CELLS, LENGTH_DIVISOR, MOST_PENALTY = 20, 3, 5, 50.0, 3.0
SAMPLE_CHARS = 100
# The target schema.
TARGETS = ("comment_id", "section", "topic", "round", "comment_type", "comment_text", "response_text", "author", "date_received", "date_responded", "status", "agency")
METADATA = ("source_file", "project", "data_structure")
# Keywords of repeated columns, all of which a header must hold.
REPEATED_WORDS = {
    "date_received": ("date", "received", "created"), "date_responded": ("date", "respond", "reply"), "status": ("status", "state"),
    "comment_type": ("type", "comment"), "comment_text": ("comment", "feedback", "text"), "response_text": ("response", "reply", "answer"),
}
# Quality rules.
REQUIRED, RECOMMENDED = ("comment_id", "comment_text", "project"), ("author", "date_received", "response_text", "status", "agency")
YEARS, COMMENT_LENGTH = (2000, 2030), (10, 10000)
