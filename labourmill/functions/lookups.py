"""Fixed values of the job feeds and of the skill categories.

Tables that would be long (names of occupational series) are parameters of their operators.
"""

# Skills of the type knowledge.
KNOWLEDGE = [
    "python", "java", "javascript", "typescript", "sql", "c++", "c#", "r programming", "aws", "azure", "gcp",
    "docker", "kubernetes", "linux", "react", "angular", "node.js", "postgresql", "mongodb", "git",
    "terraform", "devops", "scrum", "agile", "machine learning", "deep learning", "nlp",
    "artificial intelligence", "cloud computing", "data science", "data analysis", "computer vision",
    "autocad", "solidworks", "excel", "powerpoint", "tableau", "power bi", "sap", "sharepoint",
    "microsoft office", "civil engineering", "mechanical engineering", "electrical engineering",
    "chemical engineering", "biomedical engineering", "aerospace engineering", "environmental engineering",
    "structural analysis", "geotechnical", "surveying", "construction management", "chemistry", "biology",
    "nursing", "pharmacy", "clinical", "healthcare", "public health", "epidemiology", "mental health",
    "patient care", "occupational therapy", "rehabilitation", "laboratory", "diagnostics", "forensics",
    "accounting", "auditing", "budgeting", "financial analysis", "financial reporting", "cost analysis",
    "risk management", "contracting", "procurement", "supply chain", "logistics", "inventory management",
    "warehouse management", "distribution", "program management", "project management", "policy analysis",
    "contract law", "administrative law", "legal research", "litigation", "regulatory compliance",
    "regulatory analysis", "compliance", "cybersecurity", "network security", "information security",
    "intelligence analysis", "law enforcement", "surveillance", "investigation", "statistics",
    "statistical analysis", "research methodology", "scientific writing", "data collection", "lean",
    "six sigma", "quality assurance", "employee relations", "labor relations", "recruitment",
    "workforce planning", "performance management", "strategic planning", "stakeholder engagement",
]

# Skills of the type competence.
COMPETENCE = [
    "communication", "leadership", "problem solving", "critical thinking", "teamwork", "writing",
    "public speaking", "negotiation", "analytical thinking", "decision making", "training",
    "change management", "scientific writing",
]

# Taxonomy groups and their category.
GROUPS = [
    ("information and communication technologies (icts)", "IT & Technology"),
    ("digital skills", "IT & Technology"),
    ("engineering, manufacturing and construction", "Engineering"),
    ("natural sciences, mathematics and statistics", "Sciences & Analytics"),
    ("health and welfare", "Healthcare & Medicine"),
    ("social work and counselling", "Healthcare & Medicine"),
    ("business, administration and law", "Business & Finance"),
    ("accounting and taxation", "Business & Finance"),
    ("finance", "Business & Finance"),
    ("logistics, distribution and transportation", "Business & Finance"),
    ("procurement", "Business & Finance"),
    ("management and administration", "Management & Leadership"),
    ("self-management skills and competences", "Management & Leadership"),
    ("leadership skills and competences", "Management & Leadership"),
    ("leading others", "Management & Leadership"),
    ("education", "Management & Leadership"),
    ("human resources", "HR & Workforce"),
    ("social and communication skills and competences", "Soft Skills & Communication"),
    ("thinking skills and competences", "Soft Skills & Communication"),
    ("core skills and competences", "Soft Skills & Communication"),
    ("generic programmes and qualifications", "Soft Skills & Communication"),
    ("personal skills and development", "Soft Skills & Communication"),
    ("literacy and numeracy", "Soft Skills & Communication"),
    ("life skills and competences", "Soft Skills & Communication"),
    ("arts and humanities", "Soft Skills & Communication"),
    ("services", "Security & Public Safety"),
    ("security", "Security & Public Safety"),
    ("law, police and corrections", "Security & Public Safety"),
    ("social sciences, journalism and information", "Social Sciences & Policy"),
    ("agriculture, forestry, fisheries and veterinary", "Sciences & Analytics"),
    ("physical and manual skills and competences", "Engineering"),
    ("skills", "Other"),
]

# Labels and their category, in order; a label that stands twice has the later one.
LABELS = [
    ("train employees", "Management & Leadership"),
    ("lean management", "Management & Leadership"),
    ("six sigma", "Management & Leadership"),
    ("agile project management", "Management & Leadership"),
    ("manage stakeholders", "Management & Leadership"),
    ("apply change management", "Management & Leadership"),
    ("results-based management", "Management & Leadership"),
    ("project commissioning", "Management & Leadership"),
    ("knowledge management", "Management & Leadership"),
    ("office administration", "Management & Leadership"),
    ("application process", "Management & Leadership"),
    ("document management", "Management & Leadership"),
    ("assessment processes", "Management & Leadership"),
    ("manage emergency procedures", "Management & Leadership"),
    ("ensure compliance with construction project deadline", "Management & Leadership"),
    ("perform clerical duties", "Management & Leadership"),
    ("administer appointments", "Management & Leadership"),
    ("tutor students", "Management & Leadership"),
    ("manage time", "Management & Leadership"),
    ("meet deadlines", "Management & Leadership"),
    ("assume responsibility", "Management & Leadership"),
    ("make decisions", "Management & Leadership"),
    ("recruit employees", "HR & Workforce"),
    ("workforce planning", "HR & Workforce"),
    ("human resource management", "HR & Workforce"),
    ("personnel management", "HR & Workforce"),
    ("clinical skills", "Healthcare & Medicine"),
    ("provide patient care", "Healthcare & Medicine"),
    ("provide nursing care", "Healthcare & Medicine"),
    ("healthcare", "Healthcare & Medicine"),
    ("mental health", "Healthcare & Medicine"),
    ("laboratory skills", "Healthcare & Medicine"),
    ("community medicine", "Healthcare & Medicine"),
    ("pharmacy", "Healthcare & Medicine"),
    ("perform diagnostics", "Healthcare & Medicine"),
    ("apply techniques of occupational therapy", "Healthcare & Medicine"),
    ("diagnostic radiology", "Healthcare & Medicine"),
    ("oral surgery", "Healthcare & Medicine"),
    ("stomatology", "Healthcare & Medicine"),
    ("primary care", "Healthcare & Medicine"),
    ("medical terminology", "Healthcare & Medicine"),
    ("occupational health", "Healthcare & Medicine"),
    ("ensure compliance with regulations", "Legal & Compliance"),
    ("contract management", "Legal & Compliance"),
    ("audit compliance", "Legal & Compliance"),
    ("litigation", "Legal & Compliance"),
    ("regulatory analysis", "Legal & Compliance"),
    ("regulatory compliance", "Legal & Compliance"),
    ("employment law", "Legal & Compliance"),
    ("manage contracts", "Legal & Compliance"),
    ("road traffic laws", "Legal & Compliance"),
    ("amazon web services", "IT & Technology"),
    ("microsoft azure", "IT & Technology"),
    ("google cloud platform", "IT & Technology"),
    ("docker", "IT & Technology"),
    ("kubernetes", "IT & Technology"),
    ("terraform", "IT & Technology"),
    ("react", "IT & Technology"),
    ("node.js", "IT & Technology"),
    ("mongodb", "IT & Technology"),
    ("postgresql", "IT & Technology"),
    ("tableau", "IT & Technology"),
    ("power bi", "IT & Technology"),
    ("linux", "IT & Technology"),
    ("git", "IT & Technology"),
    ("sharepoint", "IT & Technology"),
    ("sap", "IT & Technology"),
    ("principles of artificial intelligence", "IT & Technology"),
    ("cloud technologies", "IT & Technology"),
    ("natural language processing", "IT & Technology"),
    ("use spreadsheets software", "IT & Technology"),
    ("use microsoft office", "IT & Technology"),
    ("air traffic management", "IT & Technology"),
    ("desktop publishing", "IT & Technology"),
    ("control systems", "IT & Technology"),
    ("office equipment", "IT & Technology"),
    ("computer technology", "IT & Technology"),
    ("computer science", "IT & Technology"),
    ("support ict system users", "IT & Technology"),
    ("distribution management", "Business & Finance"),
    ("budget management", "Business & Finance"),
    ("inventory management rules", "Business & Finance"),
    ("e-procurement", "Business & Finance"),
    ("qualitative risk analysis techniques", "Business & Finance"),
    ("financial reporting", "Business & Finance"),
    ("supply machine", "Business & Finance"),
    ("financial management", "Business & Finance"),
    ("sales activities", "Business & Finance"),
    ("business knowledge", "Business & Finance"),
    ("exert expenditure control", "Business & Finance"),
    ("process payments", "Business & Finance"),
    ("operate cash register", "Business & Finance"),
    ("stock shelves", "Business & Finance"),
    ("sell tickets", "Business & Finance"),
    ("unload cargo", "Business & Finance"),
    ("conduct investigations", "Security & Public Safety"),
    ("conduct surveillance", "Security & Public Safety"),
    ("intelligence analysis", "Security & Public Safety"),
    ("law enforcement", "Security & Public Safety"),
    ("forensic science", "Security & Public Safety"),
    ("security clearance", "Security & Public Safety"),
    ("prevent theft", "Security & Public Safety"),
    ("manage emergency procedures", "Security & Public Safety"),
    ("first response", "Security & Public Safety"),
    ("personal protective equipment", "Security & Public Safety"),
    ("alarm systems", "Security & Public Safety"),
    ("health and safety in the workplace", "Security & Public Safety"),
    ("environmental assessment", "Sciences & Analytics"),
    ("scientific writing", "Sciences & Analytics"),
    ("laboratory skills", "Sciences & Analytics"),
    ("collect data", "Sciences & Analytics"),
    ("conservation techniques", "Sciences & Analytics"),
    ("waste management", "Sciences & Analytics"),
    ("scientific research methodology", "Sciences & Analytics"),
    ("manage quantitative data", "Sciences & Analytics"),
    ("physics", "Sciences & Analytics"),
    ("write reports", "Soft Skills & Communication"),
    ("public speaking", "Soft Skills & Communication"),
    ("provide technical documentation", "Soft Skills & Communication"),
    ("customer service", "Soft Skills & Communication"),
    ("use presentation software", "Soft Skills & Communication"),
    ("deal with public", "Soft Skills & Communication"),
    ("deliver outstanding service", "Soft Skills & Communication"),
    ("make reservations", "Soft Skills & Communication"),
    ("file documents", "Soft Skills & Communication"),
    ("fill out forms", "Soft Skills & Communication"),
    ("provide information", "Soft Skills & Communication"),
    ("assist customers", "Soft Skills & Communication"),
    ("cope with stress", "Soft Skills & Communication"),
    ("exercise patience", "Soft Skills & Communication"),
    ("think analytically", "Soft Skills & Communication"),
    ("write english", "Soft Skills & Communication"),
    ("interact verbally in english", "Soft Skills & Communication"),
    ("public relations", "Soft Skills & Communication"),
    ("autocad", "Engineering"),
    ("solidworks", "Engineering"),
    ("geotechnical engineering", "Engineering"),
    ("read engineering drawings", "Engineering"),
    ("design metal components", "Engineering"),
    ("plan construction of houses", "Engineering"),
    ("maintain equipment", "Engineering"),
    ("carry objects", "Engineering"),
    ("use hand tools", "Engineering"),
    ("maintain ground", "Engineering"),
    ("hang wallpaper", "Engineering"),
    ("mechanical systems", "Engineering"),
    ("electronics", "Engineering"),
    ("types of electronics", "Engineering"),
    ("museology", "Social Sciences & Policy"),
    ("public administration", "Social Sciences & Policy"),
    ("labour relations", "HR & Workforce"),
    ("network security", "IT & Technology"),
]

# Words in a chain of groups; the first list that has one gives the category.
CHAIN_WORDS = [
    ("IT & Technology", ["ict", "digital", "computing", "software", "data", "technology"]),
    ("Healthcare & Medicine", ["health", "medical", "nursing", "care", "welfare"]),
    ("Engineering", ["engineer", "construct", "manufactur", "mechanical"]),
    ("Legal & Compliance", ["law", "legal", "compli", "regulation"]),
    ("Management & Leadership", ["manag", "leadership", "administr", "organis"]),
    ("Sciences & Analytics", ["science", "research", "mathemat", "statist", "analyt"]),
    ("Soft Skills & Communication", ["communic", "social", "personal", "literacy"]),
    ("Security & Public Safety", ["secur", "police", "safety", "protect", "investigat"]),
    ("Business & Finance", ["finance", "account", "budget", "econom", "business"]),
    ("HR & Workforce", ["human resource", "recruit", "workforce"]),
]

# Parts of an employer's name; the first list that has one gives the type.
EMPLOYERS = [
    ("Federal", ["department of", "agency", "federal", "usda", "hhs", "dod", "va", "social security", "national", "office of", "administration", "service", "bureau", "commission", "board", "corps"]),
    ("State", ["state of", "department of state", "legislature", "university of"]),
    ("Private", ["inc", "llc", "corp", "company", "ltd", "group", "solutions"]),
    ("Non-Profit", ["foundation", "non-profit", "nonprofit", "charity", "association"]),
]

# Terms that are looked for in postings.
TERMS = [
    "python", "java", "javascript", "typescript", "sql", "c++", "c#", "machine learning", "deep learning",
    "nlp", "data analysis", "data science", "cloud computing", "aws", "azure", "gcp", "docker", "kubernetes",
    "terraform", "devops", "git", "linux", "react", "angular", "node.js", "postgresql", "mongodb",
    "cybersecurity", "network security", "information security", "artificial intelligence", "computer vision",
    "civil engineering", "mechanical engineering", "electrical engineering", "structural analysis", "autocad",
    "solidworks", "construction management", "surveying", "geotechnical", "patient care", "clinical",
    "nursing", "pharmacy", "diagnostics", "healthcare", "public health", "epidemiology", "mental health",
    "rehabilitation", "occupational therapy", "financial analysis", "accounting", "auditing", "budgeting",
    "procurement", "contracting", "cost analysis", "financial reporting", "project management",
    "program management", "strategic planning", "policy analysis", "regulatory compliance",
    "stakeholder engagement", "change management", "risk management", "quality assurance", "recruitment",
    "training", "employee relations", "labor relations", "performance management", "workforce planning",
    "legal research", "litigation", "regulatory analysis", "contract law", "administrative law", "compliance",
    "research methodology", "laboratory", "field research", "statistical analysis", "data collection",
    "scientific writing", "environmental assessment", "chemistry", "biology", "supply chain", "logistics",
    "inventory management", "warehouse management", "distribution", "investigation", "law enforcement",
    "intelligence analysis", "surveillance", "forensics", "security clearance", "communication", "leadership",
    "problem solving", "critical thinking", "teamwork", "writing", "public speaking", "negotiation",
    "analytical thinking", "excel", "powerpoint", "tableau", "power bi", "sap", "sharepoint",
    "microsoft office", "agile", "scrum", "lean", "six sigma",
]

# Country names and their codes.
COUNTRIES = [
    ("united states", "US"),
    ("united kingdom", "GB"),
    ("australia", "AU"),
    ("germany", "DE"),
    ("france", "FR"),
    ("canada", "CA"),
    ("india", "IN"),
    ("brazil", "BR"),
    ("netherlands", "NL"),
    ("poland", "PL"),
    ("italy", "IT"),
    ("mexico", "MX"),
    ("belgium", "BE"),
    ("austria", "AT"),
    ("new zealand", "NZ"),
    ("singapore", "SG"),
    ("south africa", "ZA"),
    ("russia", "RU"),
    ("japan", "JP"),
]
