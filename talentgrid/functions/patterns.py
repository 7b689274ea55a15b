"""The word lists and patterns the extraction rules are defined by."""

SECTION_HEADINGS = (
    "curriculum vitae",
    "resume",
    "cv",
    "profile",
    "summary",
    "professional summary",
    "personal information",
    "contact",
    "contact information",
    "experience",
    "work experience",
    "professional experience",
    "education",
    "skills",
    "technical skills",
    "certifications",
    "projects",
    "languages",
)

JOB_TITLE_WORDS = (
    "developer",
    "engineer",
    "architect",
    "manager",
    "specialist",
    "analyst",
    "consultant",
    "administrator",
    "designer",
    "director",
    "intern",
    "student",
    "devops",
    "tester",
    "lead",
)

KNOWN_SKILLS = (
    "Spring Boot",
    "Spring",
    "JavaScript",
    "TypeScript",
    "PostgreSQL",
    "RabbitMQ",
    "Microservices",
    "Kubernetes",
    "Hibernate",
    "GraphQL",
    "MongoDB",
    "Docker",
    "Gradle",
    "Oracle",
    "Redis",
    "Kafka",
    "Maven",
    "MySQL",
    "Azure",
    "Java",
    "JPA",
    "REST",
    "Git",
    "AWS",
)

NAME_WORD = r"\p{L}[\p{L}'’.-]*"
NAME_LABEL = (
    r"(?im)^\s*(?:full\s+name|name)\s*[:\-]\s*"
    r"(" + NAME_WORD + r"(?:\s+" + NAME_WORD + r"){1,4})\s*$"
)
EXPERIENCE = (
    r"(?i)\b(\d{1,2})\+?\s*(?:years?|yrs?)\s+(?:of\s+)?(?:professional\s+)?experience\b"
)
QUALIFIED_EXPERIENCE = (
    r"(?i)\b(?:over|more\s+than|at\s+least)\s+(\d{1,2})\s*(?:years?|yrs?)"
    r"\s+(?:of\s+)?(?:professional\s+)?experience\b"
)
LOCATION = (
    r"(?im)^\s*(?:(?:preferred|current)\s+)?location\s*[:\-]\s*([^\r\n]{2,100})\s*$"
)
BASED_IN = r"(?im)^\s*(?:based\s+in|located\s+in)\s*[:\-]?\s*([^\r\n]{2,100})\s*$"
JOB_TYPE = (
    r"(?im)^\s*(?:preferred\s+(?:work\s+)?(?:type|arrangement)"
    r"|work\s+(?:type|preference|arrangement)|job\s+type)"
    r"\s*[:\-]\s*(remote|hybrid|on[-\s]?site)\s*$"
)
JOB_TYPE_LINES = ("remote", "hybrid", "onsite", "on-site", "on site")

CORRELATION_ID = r"^[A-Za-z0-9._:-]{1,128}$"
