"""Hiring-shaped rows computed from the driver's tables, one row per source row.

The driver's text is invented prose, so postings, applicant documents, profiles, evidence banks and model
answers are composed from `part`, `customer`, `orders` and `lineitem` columns.  Each composition is one SQL
expression that Spark and DuckDB read alike, so queries and oracles start from identical rows and the work
grows with the tables.
"""
from __future__ import annotations

NL = "chr(10)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(index: str, options) -> str:
    """The option at index % len(options); options are literals unless they are ('sql', expr) pairs."""
    arms = [
        f"WHEN {i} THEN {o[1] if isinstance(o, tuple) else lit(o)}" for i, o in enumerate(options)
    ]
    return f"CASE ({index}) % {len(options)} " + " ".join(arms) + " END"


def whole(expr: str) -> str:
    return f"CAST(CAST(floor({expr}) AS BIGINT) AS STRING)"


def lines(*parts: str) -> str:
    return "(" + f" || {NL} || ".join(parts) + ")"


# ------------------------------------------------------------------ postings, from part

K = "p_partkey"
YEARS = "(1 + p_size % 12)"
TITLES = (
    "Job Title: Senior Warehouse Planning Manager (Remote - Leeds)", "Data Analyst",
    "Lead Data Analyst - Remote", "Role: Software Engineer | Platform", "Staff Software Engineer",
    "Join a crew that likes puzzles", "SUPPLY ANALYST", "Principal Data Engineer @ Northwind",
    "Sr. Accountant, Finance", "Junior QA Tester", "OPEN POSITION | SUPPLY ANALYST",
    "Head of Marketing Operations Manager", "Position: Associate Project Manager",
)
COMPANY_LINES = ("Company: Acme Analytics", "About Northwind Retail", "About the team", "Employer name: Fabrikam Ltd", "")
ABOUT_LINES = ("About us", "Who we are:", "Our company", "")
BLURBS = ("We do consulting and BI for SAP customers in the UK.", "A Salesforce partner with AWS and GDPR audits.",
          "We love dashboards.")
DUTY_HEADS = ("Responsibilities:", "What you'll do", "Duties:")
DUTIES = ("- Build dashboards and reporting in Power BI and DAX", "- Write complex SQL against our data warehouse (Snowflake)",
          "- Partner on KPIs, forecasting and stakeholder management", "- Own CI/CD and monitoring on k8s",
          "- Automate reconciliation with Python; document the process")
NEED_HEADS = ("Requirements:", "QUALIFICATIONS", "What we're looking for", "Must have:", "Minimum Qualifications")
YEAR_LINES = (
    ("sql", f"'- ' || CAST({YEARS} AS STRING) || '+ years of experience with SQL and Python'"),
    ("sql", f"'- ' || CAST({YEARS} AS STRING) || '-' || CAST({YEARS} + 3 AS STRING) || ' years of experience in data analysis'"),
    ("sql", f"'- Minimum of ' || CAST({YEARS} AS STRING) || ' years in SQL Server'"),
    ("sql", f"'- ' || CAST({YEARS} AS STRING) || ' years of relevant experience, Excel and VBA'"),
    ("sql", f"'- ' || CAST({YEARS} AS STRING) || '+ years with Spark preferred'"),
    ("sql", f"'- At least ' || CAST({YEARS} AS STRING) || ' yrs in Power BI or Tableau'"),
    "- Strong SQL, Python and Excel skills",
)
DEGREE_LINES = (
    "- Bachelor's degree in a related field", "- Master's or PhD", "- Bachelor's required; Master's preferred",
    "- MBA preferred", "- B.Tech or equivalent", "- MS Excel, PowerPoint and SQL", "- Any graduate",
    "- Diploma in engineering", "- PhD in statistics a plus", "- BS in Computing. MS is a bonus", "- Scrum Master, agile",
)
SKILL_LINES = (
    "- Power BI or Tableau or Looker", "- Scrum routines (Jira, Kanban, Agile)", "- Java/Scala, SQL, or low-level C++",
    "- PostgreSQL; Snowflake (BigQuery is a plus)", "- k8s, Docker and CI/CD", "- ETL pipelines, KPIs, dashboards",
    "- AWS, Azure or GCP", "- Node.js, React and Next.js", "- Data modelling and A/B testing", "- Jira, RFP/ and GDPR",
    "- C++ and C#",
)
CERT_LINES = ("- PMP required", "- PL-300 or DP-203 preferred", "- CompTIA Security+ certification",
              "- AWS Certified Solutions Architect", "- Certified Scrum Master preferred",
              "- Lean Six Sigma Green Belt or PMP", "- Attention to detail")
NICE_HEADS = ("Nice to have:", "Preferred Qualifications")
NICE_LINES = ("- Experience with Airflow or dbt", "- Terraform, Linux", "- Exposure to machine learning concepts", "- SAP, ERP")
PLACE_LINES = ("Location: Dubai, UAE", "Based in London.", "Location: Austin, TX", "Work from office in Pune. Hybrid model",
               "Location - Toronto, Canada", "Anywhere with us", "Office in Berlin, Germany")
MODE_LINES = ("Fully remote", "Hybrid - 3 days in office", "On-site role", "Remote or hybrid", "Day shift")
PAY = "p_retailprice"
SALARY_LINES = (
    ("sql", f"'Salary: $' || {whole(PAY + ' / 10')} || 'k-' || {whole(PAY + ' / 10 + 20')} || 'k per annum'"),
    ("sql", f"'CTC: ₹' || {whole(PAY + ' / 100')} || '-' || {whole(PAY + ' / 100 + 6')} || ' LPA'"),
    "Compensation: AED 18,000 - 22,000 per month", "Pay range: $120,000 - $140,000 CAD",
    ("sql", f"'Up to £' || {whole(PAY + ' / 20')} || 'k salary'"),
    ("sql", f"'Salary from €' || {whole(PAY + ' * 50')}"),
    "Budget for 3+ years", "Salary: ₹50,000+ per month", "Salary 12 lakhs", "Competitive salary", "LPA: 6-10",
)
VISA_LINES = ("We do not sponsor visas", "Must be legally authorized to work in the US", "No visa sponsorship",
              "Candidates must hold a valid UAE residence visa", "Sponsorship is not available for this role",
              "Visa support offered", "Equal opportunity employer")

P = {
    "title": pick(K, TITLES), "company": pick(K, COMPANY_LINES), "about": pick(f"{K} + p_size", ABOUT_LINES),
    "blurb": pick(K, BLURBS), "duty_head": pick(f"{K} + 1", DUTY_HEADS), "duty": pick(f"{K} + p_size", DUTIES),
    "need_head": pick(f"{K} + 2", NEED_HEADS), "years": pick(K, YEAR_LINES), "degree": pick(K, DEGREE_LINES),
    "skill": pick(f"{K} + 3 * p_size", SKILL_LINES), "cert": pick(f"{K} + p_size", CERT_LINES),
    "nice_head": pick(K, NICE_HEADS), "nice": pick(f"{K} + 1", NICE_LINES), "place": pick(f"{K} + 3", PLACE_LINES),
    "mode": pick(f"{K} + p_size", MODE_LINES), "salary": pick(f"{K} + p_size", SALARY_LINES), "visa": pick(f"{K} + 5", VISA_LINES),
}
ORDER = ("title", "company", "about", "blurb", "duty_head", "duty", "need_head", "years", "degree", "skill", "cert",
         "nice_head", "nice", "place", "mode", "salary", "visa")
JD_TEXT = lines(*(P[name] for name in ORDER))
URLS = (
    ("sql", f"'https://boards.greenhouse.io/acme-corp/jobs/' || CAST({K} AS STRING)"),
    ("sql", f"'https://careers.fabrikam.co.uk/jobs?id=' || CAST({K} AS STRING)"),
    "https://northwind.bamboohr.com/jobs", "https://www.linkedin.com/jobs/view/12", "www.contoso.com/careers",
    "https://jobs.example.org:8443/x",
)
POSTING = f"""SELECT {K} AS jd_id, {JD_TEXT} AS jd_text, {pick(K, URLS)} AS url,
 {P['title']} AS l_title, {P['years']} AS l_years, {P['degree']} AS l_degree, {P['skill']} AS l_skill,
 {P['salary']} AS l_salary, {P['visa']} AS l_visa, {P['mode']} AS l_mode, {P['place']} AS l_place,
 {P['cert']} AS l_cert, {YEARS} AS years FROM part"""

# ------------------------------------------------------------------ applicants, from customer

C = "c_custkey"
BULLETS = (
    ("Rolled out 14 Tableau workbooks for branch managers, covering stock and returns in 9 towns", "Tableau; sql;KPI; dashboard"),
    ("Joined till receipts and loyalty records with SQL in Snowflake ahead of every Monday stock review", "sql;snowflake;reporting"),
    ("Scripted month-end file checks in Python, which spared the clerks 11 hours of hand work", "python;reconciliation"),
    ("Collected wishes of store planners and turned them into acceptance notes", "stakeholder management; requirements gathering"),
    ("Gave quarterly talks on churn to area heads", "presentation;communication"),
    ("Matched 3 years of freight invoices in Excel and Power BI before the yearly audit", "Power BI; excel;data analysis"),
    ("Moved 12 services to k8s with Docker and CI/CD on AWS", "kubernetes;docker;aws;ci/cd"),
    ("Worked on Node.js and React screens", "node.js;react"),
    ("Ran A/B tests and forecasting for 3 markets", "a/b testing;forecasting;statistics"),
    ("Kept the Salesforce CRM clean for 40 sellers", "salesforce;crm"),
    ("Responsible for payroll reconciliation", "payroll;reconciliation"),
    ("Designed PostgreSQL and Snowflake models, cutting cost by 30% over two long and rather detailed quarters of careful work with finance", "postgres;snowflake;data modelling"),
    ("Tuned Spark and Airflow pipelines handling 1,200 jobs", "spark;airflow;etl"),
    ("Led Jira boards and agile ceremonies", "jira;agile;scrum"),
    ("Documented RFP answers", "rfp;documentation"),
    ("Managed Azure and GCP budgets with Terraform", "azure;gcp;terraform"),
    ("Helped with Tableau training", "tableau"),
)
COMPANIES = ("Harbour Lane Foods", "Pinewood Freight", "Quillmark Ltd", "Toybarn Trading", "Orchard Street Importers", "Velmora", "Brightwater")
ROLE_TITLES = ("BI Analyst", "Senior Data Analyst", "Data Engineer", "Junior Accountant", "Software Developer")
CITIES = ("Pune, India", "Dubai, UAE", "London", "Toronto, Canada", "Austin, Texas", "", "Berlin")


def bullet_text(index: str) -> str:
    return pick(index, [b[0] for b in BULLETS])


def bullet_tags(index: str) -> str:
    return pick(index, [b[1] for b in BULLETS])


def role_start_year(c: str, r: str) -> str:
    """Roles 1, 2, 3 run newest first, with gaps of different lengths between them."""
    return f"(2021 - 4 * ({r} - 1) - {c} % 2)"


def role_end_year(c: str, r: str) -> str:
    return f"(2021 - 4 * ({r} - 2) - 1 - {c} % 3)"


MON = ("Jan", "Mar", "Jul", "Oct", "Sept")
_BIDX = lambda r, b: f"{C} * 5 + {r} * 7 + {b} * 3"


def _role_lines(r: int) -> list[str]:
    start = f"{pick(f'{C} + {r}', MON)} || ' ' || CAST({role_start_year(C, str(r))} AS STRING)"
    end = "'Present'" if r == 1 else f"{pick(f'{C} + {r} + 1', MON)} || ' ' || CAST({role_end_year(C, str(r))} AS STRING)"
    head = f"{pick(f'{C} + {r}', ROLE_TITLES)} || ' - ' || {pick(f'{C} + 2 * {r}', COMPANIES)} || ' (' || {start} || ' - ' || {end} || ')'"
    return [head] + [f"'- ' || {bullet_text(_BIDX(str(r), str(b)))}" for b in (1, 2)]


CONTACT = pick(C, (
    ("sql", f"'a' || CAST({C} AS STRING) || '@example.com | +91 98765 432' || CAST(10 + {C} % 90 AS STRING) || ' | Pune, India'"),
    ("sql", f"'b' || CAST({C} AS STRING) || '@example.com | linkedin.com/in/b' || CAST({C} AS STRING)"),
    "London | (555) 123-4567", "no contact given"))
RESUME_TEXT = lines(
    "c_name", CONTACT, "''", pick(C, ("Summary", "SUMMARY", "Objective", "Intro", "Profile:")),
    f"{pick(f'{C} + 1', ROLE_TITLES)} || ' with hands-on experience in ' || {pick(f'{C} * 3', ('SQL and Python', 'Power BI, DAX and Excel', 'change-request work and CRM', 'a results-driven and passionate team', 'robust, seamless, and scalable delivery'))}",
    "''", pick(f"{C} + 2", ("Experience", "Work Experience", "EXPERIENCE")),
    *_role_lines(1), *_role_lines(2), *_role_lines(3),
    "''", pick(f"{C} + 1", ("Skills", "Technical Skills", "Tools and technologies", "Abilities")),
    pick(f"{C} * 2 + 1", ("Power BI, DAX, SQL, Python", "Excel, Jira, Agile", "Docker, Kubernetes, AWS", "Salesforce, CRM, RFP, PMP", "React, Node.js, TypeScript")),
    "''", pick(C, ("Education", "EDUCATION", "Studies")),
    pick(f"{C} + 4", ("BBA in Finance, Example College (2014-2017)", "B.Tech, Example University, 01/2011 - 12/2014", "MBA 2016-07", "Self taught")),
)
RESUME = f"""SELECT {C} AS candidate_id, {RESUME_TEXT} AS text,
 {pick(f'{C} + c_nationkey', ('text', 'pdf', 'docx', 'pdf_multicol', 'docx_tables'))} AS file_type FROM customer"""

# loose, form-like profile fields (all text), from customer
PROFILE_RAW = f"""SELECT {C} AS candidate_id,
 {pick(f'{C} + c_nationkey', (('sql', f"CAST({C} % 17 AS STRING)"), ('sql', f"' ' || CAST({C} % 9 AS STRING) || '.5'"), '', 'n/a', '75'))} AS years_experience,
 {pick(f'{C} + 1', ROLE_TITLES + ('',))} AS current_title,
 {pick(C, ('bachelors', 'masters', 'diploma', '', 'PhD', 'college', 'mba'))} AS education_level,
 {pick(f'{C} + 3', ('PMP; CSM', 'PL-300', '', 'AWS Certified Solutions Architect, Certified Scrum Master'))} AS certifications,
 {pick(f'{C} + 2', CITIES)} AS location,
 {pick(f'{C} + 1', ('yes', 'No', 'true', '', 'maybe', '0'))} AS open_to_relocation,
 {pick(f'{C} + 2', ('remote, hybrid', 'Onsite', '', 'remote;hybrid;onsite', 'moon'))} AS acceptable_work_modes,
 {pick(f'{C} + 1', ('Citizen', 'Needs sponsorship', ''))} AS work_authorization,
 {pick(f'{C} + 4', ('India', 'UAE, us', '', 'United Kingdom', 'Canada; Germany'))} AS work_authorized_in,
 {pick(f'{C} + c_nationkey', ('30', '90', '91', '61', '', 'x', '400'))} AS notice_period_days,
 {pick(f'{C} + c_nationkey + 1', (('sql', whole('c_acctbal * 10')), '', ('sql', whole('c_acctbal * 20 + 50000')), 'junk'))} AS expected_salary_min,
 {pick(f'{C} + c_nationkey + 1', (('sql', whole('c_acctbal * 12 + 1000')), '', '900000', ''))} AS expected_salary_max,
 {pick(f'{C} + 1', ('USD', 'inr', ''))} AS salary_currency FROM customer"""

# evidence bank pieces, as expressions over c_custkey, r (role 1..3) and b (bullet 1..4)
BANK = {
    "company": pick(f"{C} + 2 * r", COMPANIES),
    "title": pick(f"{C} + r", ROLE_TITLES),
    "start": f"CASE r WHEN 1 THEN CAST({role_start_year(C, 'r')} AS STRING) || '-07' WHEN 2 THEN 'Mar ' || CAST({role_start_year(C, 'r')} AS STRING) ELSE CAST({role_start_year(C, 'r')} AS STRING) END",
    "end": f"CASE r WHEN 1 THEN {pick(C, ('present', '', 'Present'))} ELSE CAST({role_end_year(C, 'r')} AS STRING) || '/11' END",
    "text": f"CASE WHEN ({C} + r + b) % 11 = 0 THEN '' ELSE ' ' || {bullet_text(_BIDX('r', 'b'))} END",
    "tags": bullet_tags(_BIDX("r", "b")),
    "reviewed": pick(f"{C} + r + b", ("true", "", "no", "yes", "1")),
}
BANK_CONTACT = {"email": pick(C, ("x@example.com", "y@example.com", "")), "phone": pick(C, ("+1 555 010 9999", "")),
                "headline": pick(f"{C} + 1", ("BI Analyst", "", "Data Engineer")), "location": pick(f"{C} + 1", CITIES),
                "linkedin": pick(C, ("", ("sql", f"'linkedin.com/in/p' || CAST({C} AS STRING)"))), "website": pick(f"{C} + 1", ("", "", "p.example.org"))}
BANK_CERTS = pick(C, ('PMP', '', 'PL-300;CSM'))
EXTRA_SKILLS = pick(C, ("excel;git", "sql", "tableau; rfp", ""))

BANK_FLAT_ORACLE = f"""SELECT candidate_id, role_no, bullet_no, company, title, s AS start, e AS "end", t AS text, tags, reviewed FROM (
 SELECT {C} AS candidate_id, r AS role_no, b AS bullet_no, {BANK['company']} AS company, {BANK['title']} AS title,
 {BANK['start']} AS s, {BANK['end']} AS e, {BANK['text']} AS t, {BANK['tags']} AS tags, {BANK['reviewed']} AS reviewed
 FROM (SELECT *, unnest([1, 2, 3, 4]) AS b FROM (SELECT *, unnest([1, 2, 3]) AS r FROM customer)))"""

BANK_NESTED = f"""SELECT {C} AS candidate_id,
 named_struct('name', c_name, 'email', {BANK_CONTACT['email']}, 'phone', {BANK_CONTACT['phone']}, 'location', {BANK_CONTACT['location']},
   'linkedin', {BANK_CONTACT['linkedin']}, 'website', {BANK_CONTACT['website']}) AS contact,
 {BANK_CONTACT['headline']} AS headline,
 transform(sequence(1, 3), r -> named_struct('company', {BANK['company']}, 'title', {BANK['title']},
   'start', {BANK['start']}, 'end', {BANK['end']},
   'bullets', transform(sequence(1, 4), b -> named_struct('text', {BANK['text']},
       'skills', split({BANK['tags']}, ';'), 'reviewed', {BANK['reviewed']})))) AS roles,
 split({EXTRA_SKILLS}, ';') AS skills_extra,
 array(named_struct('degree', 'BBA', 'institution', 'Example College', 'year', '2014')) AS education,
 split({BANK_CERTS}, ';') AS certifications
 FROM customer"""

# ------------------------------------------------------------------ applications, from orders

A = "o_orderkey"
OUTCOME = (f"CASE o_orderstatus WHEN 'P' THEN 'pending' "
           f"WHEN 'F' THEN {pick(A, ('recruiter_call', 'interview', 'offer'))} "
           f"ELSE {pick(A, ('ghosted', 'rejected_auto', 'rejected_screen'))} END")
COMPONENTS = pick(A, (
    ("sql", "'{\"visibility\": {\"searches_matched\": ' || CAST(o_custkey % 6 AS STRING) || ', \"searches_total\": ' || CAST(o_custkey % 5 + 1 AS STRING) || ', \"parse_safe\": ' || CASE o_custkey % 3 WHEN 0 THEN 'false' ELSE 'true' END || '}, \"recruiter_checks\": {\"Salary\": \"' || CASE o_custkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' ELSE 'skipped' END || '\", \"Education\": \"pass\"}, \"manager_dimensions\": {\"credibility\": ' || CAST(o_custkey % 101 AS STRING) || ', \"scope_match\": null}, \"semantic_score\": ' || CAST(o_orderkey % 101 AS STRING) || ', \"keyword_score\": ' || CAST(o_custkey % 90 AS STRING) || '.5}'"),
    ("sql", "'{\"recruiter_checks\": {\"Salary\": \"fail\"}, \"manager_dimensions\": {\"credibility\": ' || CAST(o_orderkey % 97 AS STRING) || '}, \"keyword_score\": ' || CAST(o_orderkey % 83 AS STRING) || '}'"),
    "not json", ""))
APPLICATION = f"""SELECT {A} AS app_id, CAST(o_orderdate AS DATE) AS applied_date,
 {pick('o_custkey', COMPANIES)} AS company, {pick(A, ROLE_TITLES)} AS role,
 {pick(A, ('v1', 'v2', ''))} AS resume_version, 'posting text' AS jd_text,
 CASE WHEN {A} % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 500) / 10 AS DOUBLE) END AS ats_score,
 CAST({A} * 37 % 101 AS DOUBLE) AS recruiter_score,
 CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE CAST(o_custkey % 101 AS DOUBLE) END AS manager_score,
 CAST((o_custkey * 7 + {A}) % 101 AS DOUBLE) AS visibility_score,
 {OUTCOME} AS outcome, CAST(NULL AS DATE) AS outcome_date, 'note ' || CAST({A} % 7 AS STRING) AS notes,
 {COMPONENTS} AS components FROM orders"""

# every posting of every order
PAIR = """SELECT DISTINCT o_custkey AS candidate_id, l_partkey AS jd_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
