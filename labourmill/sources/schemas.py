"""Schemas of the tables and of the landed JSON."""

POSTING = (
    "position_id string, title string, organization string, department string, location_city string, location_state string, location_country string, "
    "min_salary double, max_salary double, salary_type string, job_grade string, series_code string, series_group string, qualification_summary string, "
    "major_duties string, education_requirements string, travel_percentage string, telework_eligible boolean, date_posted string, date_closing string, "
    "url string, who_may_apply string, hiring_path string, total_openings int, job_type string"
)
SKILL = "position_id string, skill_raw string, skill_esco_uri string, skill_esco_label string, skill_esco_type string, skill_category string"
LOG = "query string, keyword string, series_code string, series_name string, total_found int, jobs_collected int, started_at timestamp, finished_at timestamp, status string, error_message string"

_FEDERAL_ITEM = (
    "struct<PositionID:string,PositionTitle:string,OrganizationName:string,DepartmentName:string,"
    "PositionLocation:array<struct<CityName:string,CountrySubDivisionCode:string,CountryCode:string>>,"
    "PositionRemuneration:array<struct<MinimumRange:string,MaximumRange:string,Description:string>>,"
    "JobGrade:array<struct<Code:string>>,JobCategory:array<struct<Code:string>>,QualificationSummary:string,PublicationStartDate:string,ApplicationCloseDate:string,PositionURI:string,"
    "UserArea:struct<Details:struct<MajorDuties:string,TeleworkEligible:string,WhoMayApply:string,HiringPath:string,TotalOpenings:string,Education:string,TravelCode:string>>>"
)
#: Fields that come as a list, an object or a plain value are read as text: nested JSON stays JSON.
FEDERAL = f"SearchResult struct<SearchResultCountAll:int,SearchResultItems:array<struct<MatchedObjectDescriptor:{_FEDERAL_ITEM}>>>"
BOARD = (
    "count int, results array<struct<id:string,title:string,company:struct<display_name:string>,category:struct<label:string,tag:string>,"
    "location:struct<display_name:string,area:array<string>>,description:string,salary_min:double,salary_max:double,created:string,redirect_url:string,contract_time:string>>"
)
AGGREGATOR = "totalCount int, jobs array<struct<id:string,title:string,snippet:string,salary:string,updated:string,company:string,location:string,link:string,type:string>>"
GOLDEN = (
    "version string, created string, esco_version string, description string, "
    "thresholds struct<min_precision_at_1:double,min_mapping_rate:double,max_hallucination_rate:double,min_avg_confidence:double,label_match_ratio:int>, "
    "entries array<struct<id:string,raw_skill:string,expected_uri:string,expected_label:string,language:string,category:string,difficulty:string,llm_only:boolean,notes:string>>"
)
