"""Constants that define semantics (fixed values)."""

from __future__ import annotations

WINDOW_SIZE, NUM_WINDOWS, NUM_WINDOWS_CHAIN = 10, 5, 6
CHAIN_MONTHS, WINDOWS_PER_MONTH = 6, 1
TEXT_LONG = 500
HISTORY = 5
ACTION_WEIGHTS = {"post": 0.35, "reply": 0.30, "repost": 0.20, "like": 0.15}
ALPHA = 0.6
TRIM_TAIL = 0.05
CANDIDATES = 10
TAU_PLUS, TAU_MINUS, DELTA, ABS_DELTA = 0.06, -0.02, 0.05, 0.10
COMMERCIAL_RATIO = 0.4
CONTEXT_TOKENS, COMPLETION_MARGIN, CHARS_PER_TOKEN = 4096, 64, 3.0
BEHAVIOR_CHARS, HISTORY_CHARS, PROFILE_CHARS = 6000, 6000, 3500
MAX_TOKENS_PROFILE, MAX_TOKENS_ACTION, MAX_TOKENS_DECISION = 2048, 512, 128
TEMPERATURE_PROFILE, TEMPERATURE_COMMERCIAL, TEMPERATURE_ACTION = 0.8, 0.7, 0.0
ROUNDS = 2
SFT_T, SFT_STEP, SFT_PROFILE_ACTIONS, SFT_ACTIONS, SFT_DECISION_SHARE = 10, 1, 100, 40, 0.3

# Texts of prompts and samples.
NO_HISTORY = "(No recent actions in this window.)"
NO_DISCREPANCY = "No significant discrepancies detected."
AVAILABLE_ACTIONS = "post, reply, repost, like"
SYSTEM_PROFILE = (
    "You are an expert in computational social behavior and user modeling. "
    "Convert noisy user action traces into an abstract persona for simulation and prediction. "
    "Do not copy long raw texts verbatim; summarize into stable traits, habits, interests, and style."
)
FREE_FORM = (
    "\nYou will serve as an assistant to help generate a user profile based on the user's social media behavior history to better understand the user's interests and predict their future actions.\n"
    "\nUSER BEHAVIOR HISTORY ({action_count} records):\n{behavior_data}\n"
    "\nYour profile should:\n"
    "1. Focus on patterns that can predict FUTURE behavior (not just describe past actions)\n"
    "2. Include any dimensions you discover through analysis - don't limit yourself\n"
    "3. Capture the user's unique behavioral signatures that distinguish them from others\n"
    "4. Be actionable for predicting: what content they'll engage with, what actions they'll take, what triggers their participation\n"
    "5. Scale the depth and detail of your analysis with the amount of input data - more data should yield richer, more nuanced insights\n"
    "\nUser Profile:\n"
)
SYSTEM_REFINEMENT = (
    "You refine an existing user persona according to prediction errors. "
    "Keep useful stable traits, correct mismatches, and output one improved persona only."
)
REFINEMENT = (
    "Old persona:\n{old_persona}\n\nObserved behavior discrepancies (predicted vs actual):\n{behavior_discrepancies}\n\n"
    "Please output a revised persona that better explains actual behavior and keeps good prior information.\n"
)
DECISION_INSTRUCTION = "Predict the most likely next user action type from the available set. Return one token only: post/reply/repost/like."
DECISION_INPUT = (
    "Target user profile:\n{user_profile}\n\nRecent user actions (chronological order; oldest to newest within this block):\n{action_history}\n\n"
    "Current scenario:\n{scenario}\n\nAvailable actions:\n{available_actions}\n\nAnswer with exactly one action label.\n"
)
CONTENT_INSTRUCTION = "Generate the likely text content for the user's action. Return plain content only, no extra explanation."
CONTENT_INPUT = (
    "Target user profile:\n{user_profile}\n\nRecent user actions (chronological order; oldest to newest within this block):\n{action_history}\n\n"
    "Current scenario:\n{scenario}\n\nGenerate the text content:\n"
)
SFT_CONTENT_INSTRUCTION = (
    "Role: Social media user behavior simulation expert\n"
    "Core requirement: Match target user profile and historical behavior sequence, output content fully consistent with user characteristics\n"
    "Task objective: Restore the real content the user would publish in the specified scenario\n"
    "Output rule: Only output the content generated by the user, no additional explanation"
)
SFT_DECISION_INSTRUCTION = (
    "Role: Social media user behavior simulation expert\n"
    "Core requirement: Match target user profile and historical behavior sequence, output interaction decision fully consistent with user characteristics\n"
    "Task objective: Predict what action the user will take next based on historical behavior\n"
    "Output rule: Select one from the available actions"
)
SFT_AVAILABLE = "like, repost, reply, post, not interested"
