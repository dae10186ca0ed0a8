"""Lists, tables and labels that results must reproduce exactly."""

# Age bands as (exclusive upper bound, label); everyone else is in the last.
AGE_BANDS = [
    (5, "0-4"),
    (18, "5-17"),
    (25, "18-24"),
    (35, "25-34"),
    (45, "35-44"),
    (55, "45-54"),
    (65, "55-64"),
]
OLDEST_BAND = "65+"

# Day parts offered as filter choices.
DAY_PARTS = ["Morning", "Afternoon", "Evening", "Night"]

# Postal initial, province code, province name.
PROVINCES = [
    ("A", "NL", "Newfoundland & Labrador"),
    ("B", "NS", "Nova Scotia"),
    ("C", "PE", "Prince Edward Island"),
    ("E", "NB", "New Brunswick"),
    ("G", "QC", "Québec"),
    ("H", "QC", "Québec"),
    ("J", "QC", "Québec"),
    ("K", "ON", "Ontario"),
    ("L", "ON", "Ontario"),
    ("M", "ON", "Ontario"),
    ("N", "ON", "Ontario"),
    ("P", "ON", "Ontario"),
    ("R", "MB", "Manitoba"),
    ("S", "SK", "Saskatchewan"),
    ("T", "AB", "Alberta"),
    ("V", "BC", "British Columbia"),
    ("X", "NT/NU", "NW Territories & Nunavut"),
    ("Y", "YT", "Yukon Territory"),
]

# Postal initial, postal district name (used by the rewards fact).
POSTAL_DISTRICTS = [
    ("A", "Newfoundland and Labrador"),
    ("B", "Nova Scotia"),
    ("C", "Prince Edward Island"),
    ("E", "New Brunswick"),
    ("G", "Eastern Quebec"),
    ("H", "Metropolitan Montréal"),
    ("J", "Western Quebec"),
    ("K", "Eastern Ontario"),
    ("L", "Central Ontario"),
    ("M", "Metropolitan Toronto"),
    ("N", "Southwestern Ontario"),
    ("P", "Northern Ontario"),
    ("R", "Manitoba"),
    ("S", "Saskatchewan"),
    ("T", "Alberta"),
    ("V", "British Columbia"),
    ("X", "Northwest Territories and Nunavut"),
    ("Y", "Yukon"),
]

# Time zone per group of event regions, and the zone of all others.
REGION_ZONES = [
    (["Ontario", "Quebec", "Nunavut"], "America/Toronto"),
    (["Manitoba", "Saskatchewan"], "America/Winnipeg"),
    (["Northwest Territories", "Alberta"], "America/Yellowknife"),
    (["British Columbia", "Yukon Territory"], "America/Los_Angeles"),
]
OTHER_ZONE = "America/Moncton"

# Event region to reported region; others stay as they are.
REGION_NAMES = [
    ("Newfoundland and Labrador", "Newfoundland & Labrador"),
    ("Quebec", "Québec"),
    ("Northwest Territories", "NW Territories & Nunavut"),
    ("Nunavut", "NW Territories & Nunavut"),
]

# The weekly badge's long name and the one reported.
WEEKLY_BADGE = ("Weekly Challenge Complete", "Weekly")

# Badge labels of each report, in display order.
ACTIVITY_BADGES = ["Weekly", "2-Week Streak", "4-Week Streak"]
ENGAGEMENT_BADGES = [
    "Onboarding Complete",
    "Health Data Synced",
    "Push Notifications Enabled",
    "Answered Questions",
    "Read 5 Articles",
    "Watched 5 Videos",
    "Share on Social",
    "Opened App",
    "You Took 10!",
]
LEVEL_BADGES = [
    "50 Minutes Milestone",
    "100 Minutes Milestone",
    "150 Minute Milestone",
    "200 Minute Milestone",
    "250 Minute Milestone",
]
WEEKLY_REWARD_BADGES = ["Weekly Challenge Completed", "2-Week Streak", "4-Week Streak"]

# The label lists by report.
BADGE_REPORTS = {
    "activity": ACTIVITY_BADGES,
    "engagement": ENGAGEMENT_BADGES,
    "level": LEVEL_BADGES,
    "weekly_reward": WEEKLY_REWARD_BADGES,
}

# Period label and code.
PERIODS = {
    "This Year": "y",
    "Last Year": "yp",
    "This Quarter": "q",
    "Last Quarter": "qp",
    "This Month": "m",
    "Last Month": "mp",
    "This Week": "w",
    "Last Week": "wp",
    "Last 90 Days": "90",
    "Last 30 Days": "30",
    "Last 14 Days": "14",
    "Last 7 Days": "7",
}

# Text for a value that does not exist, and for a growth without a base.
NO_VALUE = "--"
NO_GROWTH = "N/A"

# Fixed value: rows of a page where none are asked for.
DEFAULT_PAGE_ROWS = 15
