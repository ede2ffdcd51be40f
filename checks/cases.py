"""Rule cases with verdicts worked out by hand from the rule descriptions. '{pk}' is the part number."""

JOB_LINKS = [
    ("/privacy-jobs/{pk}", "Engineer", False), ("/legal/jobs/{pk}", "Engineer", False), ("/team/jobs/{pk}", "Engineer", False),
    ("/careers", "Senior Engineer", False), ("/jobs/", "Senior Engineer", False), ("/jobs/{pk}", "Culture", True),
    ("/job/{pk}-x", "Engineer", True), ("/jobs/{pk}/search", "Engineer", True), ("/JOBS/{pk}", "Engineer", True),
    ("/positions/software-engineer", "Engineer", True), ("/positions/dev", "Developer role", False),
    ("/position/{pk}", "Engineer", True), ("/positions/culture", "Engineer", False), ("/role/data-lead", "Lead", True),
    ("/role/lead", "Lead role", False), ("/careers/senior-dev", "Home", True), ("/careers/ab-cd", "Nice title", False),
    ("/careers/12345-x", "Engineer", True), ("/careers/123456", "Engineer", True), ("/careers/12345", "Engineer", False),
    ("/en/apply/abcdef", "Apply", True), ("/en/apply/abc", "Apply here now", False),
    ("/jobs/engineeringmanager/a-b", "Manager", True), ("/jobs/engineeringmanager/a-b", "Home", False),
    ("/jobs/engineeringmanager/a-b", "abc", False), ("/jobs/engineeringmanager/a-b", " Sales ", False),
    ("/jobs/engineeringmanager/a-b", "View  All Jobs", False), ("/jobs/engineeringmanager/a-b", "OPEN\tPOSITIONS", False),
    ("/jobs/engineeringmanager/a-b", "Why Join us", False), ("/careers/x/looooooooooong/a-b", "Manager", False),
    ("/blog/post", "A nice post", False), ("/cookie-policy", "Engineer", False), ("/careers/benefits", "Engineer", False),
    ("/hiring/open_positions", "Engineer", False), ("", "Engineer", False),
]
CAREERS_SCORES = [
    ("https://boards.greenhouse.io/acme", 1000), ("https://clever.com/x", 1000), ("https://acme{pk}.com/x?ref=lever.co", 1000),
    ("https://other.com/careers", -1), ("https://acme{pk}.com/careers/culture", -1), ("https://acme{pk}.com/privacy/jobs", -1),
    ("https://acme{pk}.com/careers", 900), ("https://acme{pk}.com/Jobs/", 900), ("https://acme{pk}.com/job", 900),
    ("https://acme{pk}.com/career", 900), ("https://acme{pk}.com/en/careers", 850), ("https://acme{pk}.com/company/jobs", 850),
    ("https://acme{pk}.com/a/b/careers", -1), ("https://acme{pk}.com/a/b/jobs", 750), ("https://acme{pk}.com/open-positions", 750),
    ("https://acme{pk}.com/careers/openings", 750), ("https://acme{pk}.com/x/positions/", 750), ("https://acme{pk}.com/jobs/abc", 400),
    ("https://acme{pk}.com/careers/eng", 400), ("https://acme{pk}.com/join-us", 350), ("https://acme{pk}.com/about/careers", -1),
    ("https://acme{pk}.com/x?next=/about/jobs", 350), ("https://acme{pk}.com/work-with-us", 350),
    ("https://www.acme{pk}.com:8080/careers", 900), ("https://acme{pk}.careers/jobs", 900), ("https://jobs.acme{pk}.com/careers", -1),
    ("https://acme{pk}.com/blog", -1), ("https://u:p@ACME{pk}.com/careers", 900), ("mailto:x@acme.com", -1),
]
HUB_SCORES = [
    ("/open-positions", "View open roles", 500), ("/careers/list", "See all jobs", 450), ("/x", "Join our team", 400),
    ("/x", "We’re hiring", 400), ("/roles", "Stuff", 300), ("/careers/x", "All  Open", 250), ("/x", "open", 0),
    ("/about", "Team", 0), ("/about", "Open roles", 400), ("/privacy/open-roles", "Stuff", 0),
    ("/privacy/open-roles", "Search our jobs", 500), ("/x", "Hello", 0), ("/jobs", "Read more", 300),
    ("/x", "view something that is far too long for the rule jobs", 0), ("/Positions/", "", 300), ("/jobs/{pk}", "Engineer", 0),
]
BOARD_URLS = [
    ("https://boards.greenhouse.io/acme{pk}/jobs/1", "greenhouse", "acme{pk}"),
    ("https://job-boards.greenhouse.io/Acme{pk}?x", "greenhouse", "Acme{pk}"),
    ("https://JOBS.lever.co/acme{pk}#x", "lever", "acme{pk}"),
    ("https://jobs.ashbyhq.com/acme{pk}", "ashby", "acme{pk}"), ("https://www.jobs.ashbyhq.com/a-b_{pk}/x", "ashby", "a-b_{pk}"),
    ("https://jobs.ashbyhq.com/API", None, None), ("jobs.ashbyhq.com/acme", None, None), ("https://acme{pk}.com/jobs", None, None),
    ("https://jobs.lever.co/", None, None), ("https://x.com/?u=boards.greenhouse.io/z{pk}", "greenhouse", "z{pk}"),
]
# base, href, joined
JOINS = [
    ("https://x{pk}.com/careers", "eng", "https://x{pk}.com/careers/eng"), ("https://x{pk}.com/careers?x=1", "eng", "https://x{pk}.com/eng"),
    ("https://x{pk}.com/careers/", "../y", "https://x{pk}.com/y"), ("https://x.com", "//z{pk}.com/q", "https://z{pk}.com/q"),
    ("https://x{pk}.com/a/b", "?q=1", "https://x{pk}.com/a/b/?q=1"), ("https://x.com", "mailto:q@z{pk}", "mailto:q@z{pk}"),
    ("https://x{pk}.com/a", "b//c", "https://x{pk}.com/a/b/c"), ("https://x{pk}.com/a", "/b//c", "https://x{pk}.com/b//c"),
    ("https://x{pk}.com/a", "/./b/../c/.", "https://x{pk}.com/c/"), ("https://x{pk}.com/a", "../../../y", "https://x{pk}.com/y"),
    ("http://x{pk}.com/a", "HTTP://Y.com?", "http://Y.com"), ("https://x{pk}.com/a", "#t", "https://x{pk}.com/a/#t"),
    ("https://x{pk}.com/a", "", "https://x{pk}.com/a/"), ("https://x{pk}.com/a/b.html", "c;d?e=f#g", "https://x{pk}.com/a/b.html/c;d?e=f#g"),
    ("https://x{pk}.com", "javascript:void(0)", "javascript:void(0)"), ("https://x{pk}.com/a", "http://y.com/../z", "http://y.com/../z"),
]
# written, decoded
REFERENCES = [
    ("a &amp; b{pk}", "a & b{pk}"), ("&amp;lt;{pk}", "&lt;{pk}"), ("&copy;{pk}", "©{pk}"), ("&copy{pk}", "©{pk}"), ("&#8217;{pk}", "’{pk}"),
    ("&#x1F600;{pk}", "😀{pk}"), ("&#128;{pk}", "€{pk}"), ("&#0;{pk}", "�{pk}"), ("&bogus;{pk}", "&bogus;{pk}"), ("{pk} & 7 &&", "{pk} & 7 &&"),
    ("&notit;{pk}", "¬it;{pk}"), ("&NotEqualTilde;{pk}", "≂̸{pk}"), ("&quot;{pk}&#39;", "\"{pk}'"), ("&ndash;&hellip;{pk}", "–…{pk}"), ("plain {pk}", "plain {pk}"),
    ("&#x0000041;{pk}", "A{pk}"), ("&#00000065;{pk}", "A{pk}"),
]
