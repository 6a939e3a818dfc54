"""Word and emoji lists of the text features; every function takes its own instead, as readers.load_json reads them."""

# Fixed values, in their natural order: words and emoji that speak of distress or of comfort, and words that say nothing of either.
NEGATIVE_WORDS = (
    "نگران", "استرس", "غم", "درد", "ترس", "عذاب", "افسردگی", "تنهایی", "خشم", "نفرت", "گریه", "اشک",
    "دلشوره", "لعنت", "ستم", "ظلم", "نفرین", "اسیر", "تجاوز", "پشیمون", "کتک", "لجن", "اشغال", "شکست",
    "عصبی", "وحشت", "جدا", "طلاق", "مرگ",
)
POSITIVE_WORDS = (
    "خوشحال", "آرامش", "ممنون", "دوست", "عشق", "سلامت", "شاد", "امید", "خوب", "عالی", "قشنگ", "دلگرم",
    "موفق", "پیروز", "برکت", "تندرستی", "شکر", "سالم", "شادی", "فوق العاده", "انشاالله", "مبارک ", "ایشالله",
)
NEGATIVE_NOISE = (
    "ایا", "آیا", "بنظرتون", "نظرتون", "کیا", "چقدره", "چندهفته", "وقتتون", "مطالبو", "منظورته", "سالتونه", "وقتته",
    "بنیاد", "میخور", "پمپ", "اولته", "کشاله", "سمه", "چپم",
)
POSITIVE_NOISE = (
    "ام", "بز", "فد", "آل", "شف", "عجل", "یاس", "آم", "بشنوه", "آفر", "کن", "نکن",
    "مکن", "بکن", "بگو", "نگو", "بده", "بخور", "برو", "بیا", "باش", "باشه", "بگم", "منم",
    "نه", "آره", "سیب", "تره", "پوس", "مرغ", "کلم", "روغن", "سال", "نون", "بله", "خیر",
    "همه", "چیز", "بعد", "قبل", "حال", "زمان", "روز", "طور", "وقت", "نظر", "مخصوص",
)
POSITIVE_EMOJI = (
    "❤", "😍", "💖", "💚", "🥰", "😘", "💙", "💜", "✨", "😂", "😁", "🌸",
    "😊", "🙂", "💕", "🌷", "🧡", "🌼", "🎀", "🤣", "💞", "♥", "🤍", "🦋",
    "🌹", "🤲", "🙏", "⭐", "💫", "💗", "🌻", "💐", "💛", "💝", "🌿", "😄",
    "😇", "👍", "💯", "💪", "👶", "🤰", "💍", "🌈", "💘", "⚘", "💟", "💌",
    "🍃", "🌱", "🍀", "🌺", "🥳", "😃", "☺️", "💋", "🔥", "🫂", "🕊", "❤️‍🩹",
    "👩‍🎓", "🤌", "🌵", "❤️", "❤️‍🔥", "✅", "😅", "🌌", "🧿", "😉", "★", "🌟",
    "🥹", "😆", "🥴", "🤭", "🤩", "😀", "🩷", "🙃", "👌", "😏", "😋", "😎",
    "🤗", "💓", "😌", "😪", "☺", "🤤",
)
NEGATIVE_EMOJI = (
    "💔", "😭", "❌", "🥀", "😔", "😢", "😑", "🥺", "🔴", "⛔", "😒", "😖",
    "😡", "👎", "😩", "😤", "😞", "😟", "😰", "😨", "😓", "😠", "😣", "😕",
    "😿", "🖤", "🤦🏻", "🙄", "😬", "🥲", "😥", "😫", "😮", "😵", "🤕", "🤢",
    "👿", "🤒", "🤮", "🤧", "🤯", "🥵", "😾", "👹", "👺", "🤡", "🤬",
)
