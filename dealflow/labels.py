"""The texts that deal columns hold and that reports print.

They are part of the results and must read exactly as below.
"""

# Deal_Status
OPEN = "Open"
WON = "Won"
LOST = "Lost"

# Is_Stalled
STALLED = "TRUE"
NOT_STALLED = "FALSE"

# Stage, in pipeline order
PROSPECTING = "Prospecting"
QUALIFICATION = "Qualification"
DISCOVERY = "Discovery"
PROPOSAL = "Proposal"
NEGOTIATION = "Negotiation"
CONTRACT = "Contract"
CLOSING = "Closing"
CLOSED_WON = "Closed Won"
STAGES = (
    PROSPECTING,
    QUALIFICATION,
    DISCOVERY,
    PROPOSAL,
    NEGOTIATION,
    CONTRACT,
    CLOSING,
    CLOSED_WON,
)
LATE_STAGES = (NEGOTIATION, CONTRACT, CLOSING)
RE_ENGAGE_STAGES = (NEGOTIATION, PROPOSAL, CONTRACT)

# Account_Tier
ENTERPRISE = "Enterprise"
MID_MARKET = "Mid-Market"
SMB = "SMB"

# Deal size tier; the largest shares its name with the account tier
SMALL = "Small"
MID = "Mid"
LARGE = "Large"

# Forecast_Category
COMMIT = "Commit"
BEST_CASE = "Best Case"
UPSIDE = "Upside"
PIPELINE = "Pipeline"
OMIT = "Omit"

# Month flags
PEAK = "PEAK"
LOWEST = "LOWEST"
BEST_MONTH = "BEST MONTH"
WORST_MONTH = "WORST MONTH"

# Coverage health
COVERAGE_CRITICAL = "CRITICAL"
COVERAGE_AT_RISK = "AT RISK"
COVERAGE_BELOW_TARGET = "BELOW TARGET"
COVERAGE_HEALTHY = "HEALTHY"

# Source grades
GRADE_A = "A - HIGH PERFORMER"
GRADE_B = "B - SOLID"
GRADE_C = "C - AVERAGE"
GRADE_D = "D - HIGH DECAY"

# Risk flags of a deal
RISK_STALLED = "STALLED"
RISK_OVERDUE = "OVERDUE"
RISK_LONG_CYCLE = "EXCEEDS LOST CYCLE AVG"
RISK_STUCK = "STUCK IN STAGE"
RISK_IDLE = "NO RECENT ACTIVITY"
RISK_LOW_PROBABILITY = "LOW PROBABILITY"

# Action category of a scored deal
INTERVENE = "INTERVENE NOW"
ATTENTION = "NEEDS ATTENTION"
MONITOR = "MONITOR"

# Next step in the priority queue
ESCALATE = "ESCALATE: Overdue & stalled — involve manager"
URGENT = "URGENT: Update close date or push to close"
FINAL_PUSH = "CLOSING: Final push — confirm next steps"
RE_ENGAGE = "RE-ENGAGE: Late-stage stall — schedule call"
REVIVE = "REVIVE: Send value-add content or re-qualify"
FOLLOW_UP = "FOLLOW UP: No activity in 2+ weeks"
CHECK_IN = "CHECK IN: No activity in 1+ week"
ON_TRACK = "ON TRACK: Continue current cadence"

# Forecast flags
COMMITTED_STALLED = "MISMATCH: Committed but stalled"
COMMITTED_LOW_RATE = "MISMATCH: Committed but low historical win rate"
UNDER_CALLED = "UNDER-CALLED: Consider upgrading to Commit"

# Pipeline alerts, in the order reports list them
ALERT_NONE_90 = "CRITICAL: No pipeline in next 90 days"
ALERT_NONE_MID = "ALERT: No pipeline for days 31-90 — next quarter at risk"
ALERT_LOW_MID = "WARNING: Mid-term pipeline below 50% of quota"
ALERT_LOW_NEAR = "WARNING: Short-term pipeline below 30% of quota"
ALERT_OK = "OK"
ALERTS = (ALERT_NONE_90, ALERT_NONE_MID, ALERT_LOW_MID, ALERT_LOW_NEAR, ALERT_OK)

# Recommended action for a pipeline alert
DO_PROSPECT = "Prioritize prospecting and outbound immediately"
DO_OUTBOUND = "Increase outbound activity and work marketing leads"
DO_ACCELERATE = "Focus on accelerating existing mid-stage deals"
DO_MAINTAIN = "Maintain current activity levels"

# Reminder levels, in the order reports list them
REMIND_DEAD = "CRITICAL: 3x overdue — likely dead"
REMIND_URGENT = "URGENT: 2x overdue — re-engage immediately"
REMIND = "REMINDER: Past activity threshold"
REMINDERS = (REMIND_DEAD, REMIND_URGENT, REMIND)

# Suggested outreach per stage
OUTREACH = {
    PROSPECTING: "Send re-engagement email or reassign lead",
    QUALIFICATION: "Send re-engagement email or reassign lead",
    DISCOVERY: "Schedule discovery call follow-up",
    PROPOSAL: "Follow up on proposal — ask for feedback",
    NEGOTIATION: "Call directly — resolve blockers",
    CONTRACT: "Call directly — resolve blockers",
    CLOSING: "Escalate — involve manager to close",
}
OUTREACH_OTHER = "Review and update deal status"

# Parts of the coaching prompt
UNKNOWN_REASONS = "Unknown"

# Fit reasons of a candidate rep
FIT_REGION = "Same region"
FIT_INDUSTRY = "Industry experience"
FIT_SENIOR = "Senior for enterprise"
FIT_CAPACITY = "Has capacity"

# Commit accuracy profiles (own texts)
ACCURACY_HIGH = "HIGH ACCURACY"
ACCURACY_GOOD = "GOOD"
ACCURACY_LOW = "LOW"
ACCURACY_POOR = "UNRELIABLE"
