"""Fixed values.

Everything here must equal the values the bank, the scorer and the sessions are
defined with; they are stated as plain text and used as default arguments.
"""

# The bank and its raw sources ---------------------------------

BANK_COLUMNS = ["ID", "Domain", "Difficulty_Level", "Question", "Reference_Answer"]

QUESTION_PREFIXES = [
    "Candidate prompt",
    "Could you explain this",
    "Define and explain",
    "Interview Question",
    "Please answer the following",
]

MISSING_TEXTS = ["none", "nan"]
MIN_CHAT_ANSWER = 20

DOMAIN_LEXICON = {
    "AI/ML": [
        "machine learning", "deep learning", "neural network", "gradient",
        "overfitting", "regularization", "knn", "svm", "random forest",
        "cnn", "rnn", "lstm", "transformer", "backpropagation", "epoch",
        "batch", "loss function", "uml", "nlp", "bert", "gpt", "embedding",
        "clustering", "regression", "classification", "decision tree",
        "reinforcement", "unsupervised", "supervised", "xgboost",
    ],
    "Data Structures & Algorithms": [
        "array", "linked list", "stack", "queue", "tree", "binary",
        "graph", "hash", "sorting", "searching", "dynamic programming",
        "recursion", "big o", "complexity", "bfs", "dfs", "heap",
        "trie", "avl", "red-black", "huffman", "fibonacci", "palindrome",
        "two pointer", "sliding window", "greedy", "backtracking",
    ],
    "Core CS & OS": [
        "operating system", "process", "thread", "deadlock", "memory",
        "virtual", "paging", "segmentation", "cpu", "scheduling",
        "synchronization", "mutex", "semaphore", "network", "tcp", "udp",
        "http", "socket", "compiler", "interpreter", "java", "python",
        "c++", "pointer", "garbage", "oop", "inheritance", "polymorphism",
        "encapsulation", "abstraction", "multithreading", "concurrency",
    ],
    "Behavioral": [
        "teamwork", "conflict", "leadership", "challenge", "weakness",
        "strength", "motivation", "collaborate", "deadline", "feedback",
        "communication", "goal", "ambiguous", "failure", "success",
        "hire", "tell me about", "example of",
    ],
}
DEFAULT_DOMAIN = "Core CS & OS"

LEVEL_ALIASES = {
    "easy": "Easy", "medium": "Medium", "hard": "Hard",
    "beginner": "Easy", "intermediate": "Medium", "advanced": "Hard",
    "junior": "Easy", "senior": "Hard",
}
DEFAULT_LEVEL = "Medium"
LEVELS = ["Easy", "Medium", "Hard"]

# Texts a CSV reader of the bank takes for a missing value.
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Live scoring --------------------------------------------------

MAX_MARKS = 10

LIVE_NON_ANSWERS = ["i dont know", "i don't know", "dont know", "no idea", "pass", "skip", "n/a", ""]
LIVE_INJECTIONS = ["ignore previous", "give me a 10", "score: 10", "system prompt"]

FEEDBACK_NON_ANSWER = "No worries at all! That's a tough one. Let's just move on to the next topic."
FEEDBACK_TOO_SHORT = (
    "I'm not quite sure I follow. In a real interview, make sure to elaborate on your thought process!"
)
FEEDBACK_INJECTION = "Nice try! Let's stick to the technical questions, shall we?"
FEEDBACK_DEFAULT = "Thanks for your answer. Let's move on to the next one."
FEEDBACK_NO_SCORE = "I couldn't reliably evaluate that answer. Let's move to the next question."

LIVE_PROMPT = """\
You are an expert Senior Staff Engineer and a friendly, empathetic technical interviewer. Your task is to evaluate a candidate's answer to an interview question.

Question: {question}
Reference Answer: {reference}
Candidate's Answer: {answer}

Instructions:
1. First determine whether the candidate actually answered the specific question being asked.
2. The answer must be relevant to the exact concept, class, algorithm, problem, or topic in the question.
3. If the candidate discusses a different topic, class, algorithm, or concept, do NOT give a high score, even if the information provided is technically correct.
4. A completely off-topic answer should normally receive 0-2 marks.
5. If the answer is relevant, carefully evaluate the technical claims for factual correctness.
6. Before assigning marks, identify the important factual claims made by the candidate.
7. Check each important technical claim against your own technical knowledge and the reference answer.
8. Distinguish clearly between correct concepts, missing concepts, and incorrect technical claims.
9. A technically incorrect claim must reduce the score even if the answer is detailed, fluent, or confident.
10. Multiple major technical errors must prevent a high score.
11. Do NOT give 9-10 marks to an answer containing major factual misconceptions.
12. Correct statements that go beyond the reference answer should receive credit and should NOT reduce the score.
13. The candidate does NOT need to use the same wording as the reference answer.
14. Accept technically correct explanations that use different wording, terminology, examples, formulas, or structure.
15. Do not penalize an answer simply because it is more detailed than the reference answer.
16. Do not award marks merely because the answer is long. Judge the technical content.
17. Write a brief, conversational response of 1-3 sentences addressed directly to the candidate. Validate correct points, gently correct important misconceptions, and mention important missing concepts when appropriate.

Scoring:
18. Evaluate the answer using these four dimensions:
   - Relevance: 0-2 marks. Does the answer directly address the specific question?
   - Technical correctness: 0-4 marks. Are the important technical claims correct?
   - Completeness: 0-2 marks. Does the answer cover the essential concepts required by the question?
   - Clarity: 0-2 marks. Is the explanation clear and understandable?
   Add these four values to obtain the final score out of 10.

19. If the answer is completely off-topic, normally give 0-2 marks.
20. If the answer is relevant but contains major technical misconceptions, normally give no more than 5 marks.
21. If the answer is relevant, mostly correct, but has important omissions or minor errors, give partial credit.
22. An answer should receive 9-10 marks only when it is relevant, technically accurate, and substantially complete.
23. Correct additional information must not reduce the score.
24. Do not confuse confidence, length, or detail with correctness.

You MUST format your output EXACTLY using these XML tags. Do not output anything else:
<feedback>Your conversational response here.</feedback>
<score>Your integer score here</score>

Output:
"""

# Benchmark scoring ---------------------------------------------

EVAL_NON_ANSWERS = ["i don't know", "i dont know", "dont know", "don't know", "no idea", "pass", "skip", ""]
EVAL_GIBBERISH = ["bleh blah blah", "asdfghjkl", "qwerty", "x y z", "nothing"]
EVAL_STOPWORDS = [
    "a", "an", "the", "is", "it", "in", "of", "to", "and", "or",
    "that", "its", "are", "for", "on", "as", "by", "at", "be", "this",
    "with", "when", "from", "has", "which", "also", "can", "not",
]
OVERLAP_HIT = 0.55
OVERLAP_SCORE = 9

EVAL_PROMPT = """\
You are a strict technical interviewer grading a candidate.

Question: {question}
Ideal Answer: {reference}
Candidate Answer: {answer}

Rate the candidate answer from 0 to 10 using this rubric:
0-3: wrong, gibberish, or completely off-topic
4-7: partially correct but missing key concepts
8-10: accurate, complete, and clearly explained

Respond with ONLY a single integer (0-10). No explanation.
Score:"""

TIERS = ["P", "M", "W"]
TIER_NAMES = {"P": "Perfect", "M": "Partial", "W": "Wrong"}
TIER_EXPECTED = {"P": 9.0, "M": 5.5, "W": 1.0}
TIER_P_FROM, TIER_M_FROM = 8, 4
# Marks that count as right for a tier, both ends included.
TIER_RIGHT = {"P": (7, 10), "M": (3, 7), "W": (0, 3)}

# Sessions ------------------------------------------------------

PHASE_LIMITS = {"Easy": 5, "Medium": 8, "Hard": 5}
PASS_THRESHOLD = 0.70
STRONG_HIRE, LEANING_HIRE, NO_HIRE = "STRONG HIRE", "LEANING HIRE", "NO HIRE"
STRONG_HIRE_FROM, LEANING_HIRE_FROM = 80, 60
STRONG_HIRE_ADVICE = "STRONG HIRE"
LEANING_HIRE_ADVICE = "LEANING HIRE (Requires further review)"
NO_HIRE_ADVICE = "NO HIRE (Needs more foundational study)"
EASY_DONE = "Easy round complete. Advancing to Medium."
HARD_DONE = "Hard round complete. Interview finished!"
MEDIUM_DONE, MEDIUM_PASSED, MEDIUM_FAILED = (
    "Medium round complete ({ratio}). ", "Advancing to Hard.", "Below threshold ({threshold}). Interview concluded.",
)
BAND_PASS_FROM, BAND_SIGNAL_FROM = 7, 4
QUIT_WORD = "quit"
STEPS_PER_EPOCH = 750

# Fine-tuning text ----------------------------------------------

SFT_TEMPLATE = "Domain: {domain}\nDifficulty: {level}\nQuestion: {question}\nIdeal Answer: {answer}"
