"""Knowledge triples, prompt blocks and conversation templates as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import strip, text

# Placeholder fields, image tokens, the open-question text and the conversation templates.
PLACEHOLDER_FIELDS = ["", "_", "none", "null"]
IMAGE, IMAGE_START, IMAGE_END = "<image>", "<im_start>", "<im_end>"
OPEN_LINES = [
    "You are answering a medical VQA question.",
    "Return ONLY the final answer.",
    "- Keep it short: 1 to 4 words.",
    "- No explanations, no full sentences.",
    "- If yes/no: output exactly 'yes' or 'no'.",
    "- If a number: output only the number (and unit only if needed).",
]


@dataclass(frozen=True)
class Template:
    style: str
    roles: tuple[str, str]
    system: str = ""
    sep: str = ""
    sep2: str = ""
    opening: tuple[str, ...] = ()


_CURIOUS_HUMAN = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
_CURIOUS_USER = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_VISION = "You are a helpful language and vision assistant. You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
_TAGGED = "A chat between a curious user and an artificial intelligence assistant. The assistant is able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language.The visual content will be provided with the following format: <Image>visual content</Image>."
_MPT = "<|im_start|>system\nA conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers."
_SAFE = "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information."
_EXAMPLE = (
    'What are the key differences between renewable and non-renewable energy sources?',
    'Renewable energy sources are those that can be replenished naturally in a relatively short amount of time, such as solar, wind, hydro, geothermal, and biomass. Non-renewable energy sources, on the other hand, are finite and will eventually be depleted, such as coal, oil, and natural gas. Here are some key differences between renewable and non-renewable energy sources:\n1. Availability: Renewable energy sources are virtually inexhaustible, while non-renewable energy sources are finite and will eventually run out.\n2. Environmental impact: Renewable energy sources have a much lower environmental impact than non-renewable sources, which can lead to air and water pollution, greenhouse gas emissions, and other negative effects.\n3. Cost: Renewable energy sources can be more expensive to initially set up, but they typically have lower operational costs than non-renewable sources.\n4. Reliability: Renewable energy sources are often more reliable and can be used in more remote locations than non-renewable sources.\n5. Flexibility: Renewable energy sources are often more flexible and can be adapted to different situations and needs, while non-renewable sources are more rigid and inflexible.\n6. Sustainability: Renewable energy sources are more sustainable over the long term, while non-renewable sources are not, and their depletion can lead to economic and social instability.\n',
)
TEMPLATES = {
    "v0": Template("single", ("Human", "Assistant"), _CURIOUS_HUMAN, "###", opening=_EXAMPLE),
    "vision_v0": Template("single", ("Human", "Assistant"), _CURIOUS_HUMAN, "###"),
    "llama_2": Template("llama_2", ("USER", "ASSISTANT"), _SAFE, "<s>", "</s>"),
    "v1": Template("two", ("USER", "ASSISTANT"), _CURIOUS_USER, " ", "</s>"),
    "plain": Template("plain", ("", ""), "", "\n"),
    "v0_mmtag": Template("single", ("Human", "Assistant"), _TAGGED, "###"),
    "vision_v1": Template("two", ("USER", "ASSISTANT"), _CURIOUS_HUMAN, " ", "</s>"),
    "v1_mmtag": Template("two", ("USER", "ASSISTANT"), _TAGGED, " ", "</s>"),
    "vision_llama_2": Template("llama_2", ("USER", "ASSISTANT"), _VISION, "<s>", "</s>"),
    "mistral_instruct": Template("llama_2", ("USER", "ASSISTANT"), "", "", "</s>"),
    "mpt": Template("mpt", ("<|im_start|>user\n", "<|im_start|>assistant\n"), _MPT, "<|im_end|>"),
    "mistral": Template("mistral", ("USER", "ASSISTANT")),
}
ALIASES = {"default": "v0", "vicuna_v1": "v1", "v0_plain": "plain"}


def template(name: str) -> Template:
    return TEMPLATES[ALIASES.get(name, name)]


def is_placeholder(field: Column) -> Column:
    return F.lower(strip(field)).isin(PLACEHOLDER_FIELDS)


def is_meaningful(field: Column) -> Column:
    return ~is_placeholder(field) & (F.lower(strip(field)) != "vhead")


def is_real(triple: Column) -> Column:
    """At least two meaningful fields."""
    return F.size(F.filter(triple, is_meaningful)) >= 2


def wrap_flat(fields: Column) -> Column:
    """A flat array of three texts is one triple, of any other size one-field triples."""
    return F.when(F.size(fields) == 3, F.array(fields)).otherwise(F.transform(fields, lambda x: F.array(x)))


def format_triples(triples: Column) -> Column:
    """'(a, b); (c, d)' of the real triples with their meaningful fields; '' for none."""
    real = F.filter(F.coalesce(triples, F.array().cast("array<array<string>>")), is_real)
    return F.array_join(F.transform(real, lambda t: F.concat(F.lit("("), F.array_join(F.transform(F.filter(t, is_meaningful), strip), ", "), F.lit(")"))), "; ")


def triples_context(triples: Column, base_type: Column, mode: str) -> Column:
    """Context by mode off, real_only or kvqa_real_only."""
    if mode == "off":
        return F.lit("")
    if mode == "kvqa_real_only":
        return F.when(F.lower(text(base_type)) == "kvqa", format_triples(triples)).otherwise("")
    if mode == "real_only":
        return format_triples(triples)
    raise ValueError(f"unknown mode {mode}")


def append_context(question: Column, triples: Column, max_triples: int | None = None, triple_k: int | None = None) -> Column:
    """The triples, cut to so many triples and fields, before the question; without real triples the question alone."""
    t = F.coalesce(triples, F.array().cast("array<array<string>>"))
    t = F.slice(t, 1, max_triples) if max_triples is not None else t
    t = F.transform(t, lambda x: F.slice(x, 1, triple_k)) if triple_k is not None else t
    ctx = format_triples(t)
    return F.when(ctx == "", text(question)).otherwise(F.concat(F.lit("Context triples: "), ctx, F.lit(". Question: "), text(question)))


def open_text(question: Column) -> Column:
    return F.concat(F.lit("\n".join(OPEN_LINES) + "\nQuestion: "), text(question))


def question_block(question: Column, context: Column) -> Column:
    q = F.concat(F.lit("Question: "), strip(question))
    return F.when(context == "", q).otherwise(F.concat(F.lit("Context triples: "), context, F.lit("\n"), q))


def closed_text(question: Column, context: Column, options: Column) -> Column:
    kept = F.array_join(F.filter(F.transform(options, strip), lambda o: o != ""), "; ")
    return F.concat(question_block(question, context), F.when(kept == "", "").otherwise(F.concat(F.lit("\nOptions: "), kept)), F.lit("\nAnswer:"))


def with_image(user_text: Column, start_end: bool = False) -> Column:
    return F.concat(F.lit((IMAGE_START + IMAGE + IMAGE_END if start_end else IMAGE) + "\n"), user_text)


def render(messages: Column, name: str) -> Column:
    """Prompt of an ordered array of texts, user first; a null or empty text is still to be generated."""
    t = template(name)
    if t.opening:
        messages = F.concat(F.array(*[F.lit(m) for m in t.opening]), messages)
    role = lambda i: F.when(i % 2 == 0, t.roles[0]).otherwise(t.roles[1])
    given = lambda m: m.isNotNull() & (m != "")
    joined = lambda f: F.array_join(F.transform(messages, f), "")
    if t.style == "single":
        return F.concat(F.lit(t.system + t.sep), joined(lambda m, i: F.when(given(m), F.concat(role(i), F.lit(": "), m, F.lit(t.sep))).otherwise(F.concat(role(i), F.lit(":")))))
    if t.style == "two":
        sep = lambda i: F.when(i % 2 == 1, t.sep2 + " ").otherwise(t.sep)
        return strip(F.concat(F.lit(t.system + t.sep), joined(lambda m, i: F.when(given(m), F.concat(role(i), F.lit(": "), strip(m), sep(i))).otherwise(F.concat(role(i), F.lit(":"))))))
    if t.style == "mpt":
        return F.concat(F.lit(t.system + t.sep), joined(lambda m, i: F.when(given(m), F.concat(role(i), m, F.lit(t.sep))).otherwise(role(i))))
    if t.style == "llama_2":
        head = f"<<SYS>>\n{t.system}\n<</SYS>>\n\n" if t.system else ""
        inst = lambda m, i: F.concat(F.lit(t.sep + "[INST] "), F.when(i == 0, head).otherwise(""), m, F.lit(" [/INST]"))
        out = joined(lambda m, i: F.when(~given(m), "").when(i % 2 == 0, inst(m, i)).otherwise(F.concat(F.lit(" "), m, F.lit(" " + t.sep2))))
        # the first separator's characters are stripped from the left; without any, white space is
        return F.ltrim(out, F.lit(t.sep)) if t.sep else F.regexp_replace(out, r"^\s+", "")
    if t.style == "plain":
        return F.concat(F.lit(t.system), joined(lambda m, i: F.when(given(m), F.concat(m, F.when(i % 2 == 0, t.sep).otherwise(t.sep2))).otherwise("")))
    inst = lambda m, i: F.concat(F.lit("[INST] "), F.when(i == 0, F.concat(F.lit(t.system + " "), strip(m))).otherwise(m), F.lit(" [/INST]"))
    return joined(lambda m, i: F.when(~given(m), "").when(i % 2 == 0, inst(m, i)).otherwise(F.concat(m, F.lit("</s>"))))


def build_prompt(user_text: Column, name: str, answer: Column | None = None, image: bool = True, start_end: bool = False) -> Column:
    first = with_image(user_text, start_end) if image else user_text
    return render(F.array(first, answer if answer is not None else F.lit(None).cast("string")), name)


def stop_string(name: str) -> str | None:
    t = template(name)
    return (t.sep2 if t.style == "two" else t.sep) or t.sep2 or None


def image_tokens(prompt: Column) -> Column:
    return F.regexp_count(text(prompt), F.lit(IMAGE)).cast("int")


def judge_prompt(label: Column, caption: Column, mention: Column, question: Column, answer1: Column, answer2: Column, role: str = "Assistant", instruction: str = "") -> Column:
    """Context, question and two answers in marked blocks, then the instruction."""
    answer = lambda n, x: [F.lit(f"[{role} {n}]\n"), text(x), F.lit(f"\n\n[End of {role} {n}]\n\n")]
    head = [F.lit("[Context]\nFigure Caption:\n"), text(label), F.lit(": "), text(caption), F.lit("\n\nFigure Context:\n\t- "), text(mention), F.lit("\n\n[Question]\n"), text(question), F.lit("\n\n")]
    return F.concat(*head, *answer(1, answer1), *answer(2, answer2), F.lit(f"[System]\n{instruction}\n\n"))


def chat_messages(system: Column, user: Column) -> Column:
    entry = lambda role, x: F.struct(F.lit(role).alias("role"), text(x).alias("content"))
    return F.array(entry("system", system), entry("user", user))


def sft_conversation(question: Column, answer: Column, start_end: bool = False) -> Column:
    entry = lambda who, x: F.struct(F.lit(who).alias("from"), x.alias("value"))
    return F.array(entry("human", with_image(text(question), start_end)), entry("gpt", text(answer)))


def add_image_token(message: Column, has_image: Column, limit: int = 1536, image_limit: int = 1200) -> Column:
    """A message cut to its limit, with the image token in front or behind where an image came without one."""
    cut = F.substring(text(message), 1, limit)
    short = F.substring(cut, 1, image_limit)
    return F.when(~has_image, cut).when(F.contains(short, F.lit(IMAGE)), short).otherwise(F.concat(short, F.lit("\n" + IMAGE)))
