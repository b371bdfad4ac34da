"""Explicit schemas of the nested snapshots; nothing is inferred, codes stay text."""

CATALOG_COURSE = """
termCode string, courseId string, catalogNumber string, courseDesignation string,
fullCourseDesignation string, title string, description string, enrollmentPrerequisites string,
lastTaught string, minimumCredits double, maximumCredits double, currentlyTaught boolean,
lastUpdated bigint,
subject struct<subjectCode:string, shortDescription:string, description:string, footnotes:array<string>>
"""

STATUS = "struct<openSeats:int, waitlistCurrentSize:int, capacity:int, currentlyEnrolled:int>"

INSTRUCTOR = "struct<netid:string, email:string, name:struct<first:string, last:string>, first_name:string, last_name:string>"

MEETING = """struct<meetingType:string, meetingTimeStart:bigint, meetingTimeEnd:bigint, meetingDays:string,
startDate:bigint, endDate:bigint, examDate:bigint, room:string,
building:struct<buildingCode:string, buildingName:string, streetAddress:string, latitude:double, longitude:double>>"""

SECTION = f"""struct<classUniqueId:struct<termCode:string, classNumber:bigint>, courseId:string, sectionNumber:string,
type:string, instructionMode:string, sessionCode:string, published:boolean, enrollmentStatus:{STATUS},
footnotes:array<string>, instructors:array<{INSTRUCTOR}>, instructor:{INSTRUCTOR},
classMaterials:array<struct<sectionNotes:string, classUniqueId:struct<classNumber:bigint>>>,
classMeetings:array<{MEETING}>>"""

PACKAGE = f"""struct<id:string, enrollmentClassNumber:bigint, sequenceNumber:string, docId:string,
termCode:string, subjectCode:string, courseId:string, lastUpdated:bigint, onlineOnly:boolean, isAsynchronous:boolean,
packageEnrollmentStatus:struct<status:string, availableSeats:int, waitlistTotal:int>,
enrollmentStatus:{STATUS},
enrollmentRequirementGroups:struct<catalogRequirementGroups:array<struct<description:string>>,
classAssociationRequirementGroups:array<struct<description:string>>>,
instructorProvidedClassDetails:struct<instructorDescription:string, typicalTopicsAndOrSchedule:string, format:string>,
modesOfInstruction:array<string>, sections:array<{SECTION}>>"""

PACKAGE_SNAPSHOT = f"""termCode string, results array<struct<
course:struct<termCode:string, subjectCode:string, courseId:string, catalogNumber:string, courseDesignation:string,
fullCourseDesignation:string, title:string, description:string, minimumCredits:double, maximumCredits:double,
enrollmentPrerequisites:string, currentlyTaught:boolean, lastTaught:string,
subject:struct<subjectCode:string, shortDescription:string, description:string>>,
packages:array<{PACKAGE}>>>"""

# The nine parts of a history snapshot.
HISTORY_PARTS = [
    "manifest",
    "courses",
    "course-grades",
    "course-offerings",
    "course-grade-distributions",
    "instructors",
    "instructor-grades",
    "instructor-grade-distributions",
    "match-report",
]

HISTORY_SCHEMAS = {
    "manifest": "generatedAt string, source string, sourceTermCode string, matchedCourseCount int, matchedInstructorCount int",
    "courses": "course_id bigint, subject_code string, catalog_number string, course_designation string, name string, "
    "names array<string>, subjectAliases array<string>",
    "course-grades": "course_grade_id bigint, course_id bigint, term_code string, student_count int, avg_gpa double",
    "course-offerings": "course_offering_id bigint, course_id bigint, instructor_id bigint, term_code string, "
    "section_type string, student_count int, avg_gpa double",
    "course-grade-distributions": "course_grade_id bigint, grades map<string,bigint>",
    "instructors": "instructor_id bigint, display_name string",
    "instructor-grades": "instructor_grade_id bigint, instructor_id bigint, term_code string, student_count int, avg_gpa double",
    "instructor-grade-distributions": "instructor_grade_id bigint, grades map<string,bigint>",
    "match-report": "courseMatches array<struct<term_code:string, local_course_id:string, course_id:bigint, match_status:string, "
    "matched_at:string>>, instructorMatches array<struct<instructor_key:string, instructor_id:bigint, match_status:string, matched_at:string>>",
}
