"""Texts given from outside: page markup to look for, service replies, address and file forms.

All of these are fixed values. They must stay exactly as they are, or pages
written by the shop and replies sent by the fetch service are no longer recognised.
"""

# Where a fact stands in the decoded product page.
PRODUCT_NAME = r"<title>(Amazon.com\s*:\s*)?(.+?)(\s*- - Amazon.com)?</title>"
TOTAL_RATINGS = r'<span id="acrCustomerReviewText" class="a-size-base">(.*?) ratings</span>'
AVERAGE_RATING = (
    r'<span id="acrPopover" class="reviewCountTextLinkedHistogram noUnderline" '
    r'title="(.*?) out of 5 stars">'
)
ANSWERED_QUESTIONS = r'<span class="a-size-base">\n(.*?)\+? answered questions\n</span>'

# Where a fact stands in the decoded reviews page.
TOTAL_REVIEWS = r"Showing [-\d]+ of (.*?) reviews"
POSITIVE_REVIEWS = r"See all (.*?) positive reviews"
CRITICAL_REVIEWS = r"See all (.*?) critical reviews"

# A reply holding one of these is not a page, whatever its status.
QUOTA_USED_UP = '{"error":"Not enough requests."}'
KEY_MISSING = '{"error":"No apikey provided."}'
ROBOT_CHECK = "Sorry, we just need to make sure you're not a robot."
UNUSABLE_MARKERS = (QUOTA_USED_UP, KEY_MISSING, ROBOT_CHECK)

# Page address and cache file name, {} standing for the identifier.
INFO_URL = "https://www.amazon.com/dp/{}"
REVIEWS_URL = "https://www.amazon.com/product-reviews/{}"
INFO_FILE = "{}.html"
REVIEWS_FILE = "reviews-{}.html"

# The identifier list that is read if none is named.
DEFAULT_IDENTIFIERS = "Asins sample.csv"

# Crawl defaults.
MAX_ITERATIONS = 20
INITIAL_DELAY = 0
DELAY_DELTA = 10

# Report layout.
TRUNCATE_AFTER = 26
LISTING_NAME_WIDTH = 25
